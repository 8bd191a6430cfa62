"""Secret scans with DataFrame functions only: base formats, and windows of high Shannon entropy.

A candidate is a run of 20 or more characters that keys are written in. It gets a character class (hex or base64).
A window of that many characters slides over it; the counts of the characters in the window change by one in and one
out at each step, and with them the sum of c*log2(c), held as a whole number. Windows whose entropy reaches their
class's threshold are joined into spans. An allow-list suppresses candidates that are harmless as a whole (digests with a
name, UUIDs, words, paths, numbers), and spans of which placeholders make up half or more; a placeholder's name somewhere in a
long key suppresses nothing. Spans are held against the base spans by one sweep in order of place.

Null text counts as empty; an empty text has no spans; repeated rows each get the same result; an empty table gives an
empty table; other columns pass through, and the result columns' names give way to columns that are there already.
The work is one pass over each row: no shuffle, and nothing is gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh, joined, let, matches, q, reach, read

# The base formats in their order; `least` is the fewest characters of the tested part.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run is matched to its end, so this keeps just the runs of 20
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?:(?:sha|md)[0-9]{1,3}:)?[A-Za-z0-9+/_=-]{20,}"
# What the allow-list lets pass.
ALLOWED = [
    r"^(?:sha|md)[0-9]{1,3}[:-]",  # named digests, as in lock files
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUIDs
    r"^[A-Za-z]?[a-z/_=-]+$",  # words, slugs and paths in lower case
    r"^[A-Z/_=-]+$",  # the same in upper case
    r"^(?:[A-Z]?[a-z]{2,}+[0-9]{0,2}+[/_=-]*+)++$",  # names in camel case; possessive, so that Java's matcher doesn't recurse
    r"^[0-9/_=+-]+$",  # numbers and dates
    r"EXAMPLE(?:KEY)?$",  # keys of documentation
]
PLACEHOLDER = r"(?i)(?:example|placeholder|dummy|changeme|x{5,}+|abcdefgh|12345678|0{8,}+)"  # suppress a span that is made of them by half or more
WORD = "+/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-"
SCALE = 1_000_000
WINDOWS = 1024  # in a block


@dataclass(frozen=True)
class EntropyClass:
    """`pattern`: which candidates it takes; windows of `window` characters need `bits` of entropy."""

    kind: str
    pattern: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of c*log2(c), scaled, that a window of enough entropy has."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * SCALE)


CLASSES = (
    EntropyClass("entropy_hex", r"^[0-9A-Fa-f]+=*$", 20, 3.0),
    EntropyClass("entropy_base64", r".", 20, 3.6),
)


def _hot_windows(codes: Column, cls: EntropyClass) -> Column:
    """Spans within the candidate, joined from windows of enough entropy. `codes`: one-based places in WORD.

    The windows are taken in blocks, each of which first counts the characters of the window before its own first one.
    """
    last, none = F.size(codes) - 1, F.array().cast("array<struct<s:int,e:int>>")
    block = lambda b: _slide(codes, cls, b * WINDOWS, F.least(last, (b + 1) * WINDOWS - 1))
    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.floor(last / WINDOWS).cast("int")), block))
    first = lambda a: F.filter(a, lambda x, i: F.coalesce(x["s"] > F.get(a, i - 1)["e"], F.lit(True)))
    final = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["s"] > x["e"], F.lit(True)))
    whole = lambda a: F.when(last < WINDOWS, a).otherwise(F.zip_with(first(a), final(a), lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e"))))
    return F.when(F.size(codes) < cls.window, none).otherwise(let(spans, whole))


def _slide(codes: Column, cls: EntropyClass, begin: Column, end: Column) -> Column:
    """Spans of the windows that end at the characters from `begin` to `end`.

    The counts are a string with a letter for each character of WORD, so that a step changes two letters.
    """
    w = cls.window
    weight = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(w + 2)])
    count = lambda counts, c: F.ascii(F.substring(counts, c, 1)) - 65
    put = lambda counts, c, n: F.overlay(counts, F.chr(n + 65), c, 1)
    start = F.struct(F.lit("A" * len(WORD)).alias("counts"), F.lit(0).cast("int").alias("sum"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    warm = F.greatest(F.lit(0), begin - (w - 1))

    def slide(acc: Column, i: Column) -> Column:
        def enter(counts: Column) -> Column:
            c = F.get(codes, i)
            return let(count(counts, c), lambda n: F.struct(put(counts, c, n + 1).alias("counts"), (acc["sum"] + F.get(weight, n + 1) - F.get(weight, n)).alias("sum")))

        def leave(now: Column) -> Column:
            c = F.get(codes, i - w)
            return F.when(i < warm + w, now).otherwise(
                let(count(now["counts"], c), lambda n: F.struct(put(now["counts"], c, n - 1).alias("counts"), (now["sum"] - F.get(weight, n) + F.get(weight, n - 1)).alias("sum")))
            )

        def mark(now: Column) -> Column:
            s, e, last = i - (w - 1), i + 1, F.try_element_at(acc["out"], F.lit(-1))
            joins = last.isNotNull() & (last["e"] >= s)
            longer = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["s"].alias("s"), e.alias("e"))))
            hot = (s >= 0) & (i >= begin) & (now["sum"] <= cls.most)
            out = F.when(~hot, acc["out"]).when(joins, longer).otherwise(F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))))
            return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), out.alias("out"))

        return let(let(enter(acc["counts"]), leave), mark)

    return F.aggregate(F.sequence(warm, end), start, slide, lambda acc: acc["out"])


def _in_text(cand: Column, codes: Column, cls: EntropyClass) -> Column:
    filler = lambda x: F.char_length(F.regexp_replace(F.substring(cand["m"], x["s"] + 1, x["e"] - x["s"]), PLACEHOLDER, "")) * 2 <= x["e"] - x["s"]
    hot = F.filter(let(codes, lambda codes: _hot_windows(codes, cls)), lambda x: ~filler(x))
    return F.transform(hot, lambda x: F.struct((cand["s"] + x["s"]).alias("s"), (cand["s"] + x["e"]).alias("e"), F.lit(cls.kind).alias("kind")))


def _entropy_spans(text: Column) -> Column:
    """array<struct<s,e,kind>> of all candidates' hot windows that the allow-list doesn't suppress."""
    allowed = lambda m: F.coalesce(m.rlike("|".join(f"(?:{p})" for p in ALLOWED)), F.lit(False))

    def of(cand: Column) -> Column:
        codes = F.transform(F.split(cand["m"], ""), lambda c: F.instr(F.lit(WORD), c))
        spans = F.lit(None).cast("array<struct<s:int,e:int,kind:string>>")
        for cls in reversed(CLASSES):
            spans = F.when(cand["m"].rlike(cls.pattern), _in_text(cand, codes, cls)).otherwise(spans)
        return spans

    return F.flatten(F.transform(F.filter(matches(text, CANDIDATE), lambda c: ~allowed(c["m"])), of))


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `secrets_base` and `secrets`: array<struct<s,rank,e,kind>> in order of start, then kind.

    `secrets` has the base spans, all of them, and the entropy spans that no base span covers.
    """
    base_name, all_name, extra = fresh(df, "secrets_base", "secrets", "secrets_entropy")
    kind = lambda spans, name, rank: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(name).alias("kind")))
    body = F.coalesce(q(text), F.lit(""))
    assign = F.filter(matches(body, ASSIGN), lambda x: F.char_length(F.regexp_replace(x["m"], ASSIGN_HEAD, "")) >= 6)
    base = F.array_sort(F.concat(kind(assign, "assign", 0), kind(matches(body, ACCESS), "access", 1), kind(matches(body, HEX), "hex", 2)))
    df = df.withColumns({base_name: base, extra: _entropy_spans(body)})
    kinds = "struct<s:int,e:int,kind:string>"
    free = F.filter(reach(q(extra), q(base_name), kinds, "s", 1), lambda x: x["far"] < x["x"]["e"])
    added = F.transform(free, lambda x: F.struct(x["x"]["s"].alias("s"), F.lit(3).alias("rank"), x["x"]["e"].alias("e"), x["x"]["kind"].alias("kind")))
    return df.withColumn(all_name, F.when(F.size(extra) == 0, q(base_name)).otherwise(F.array_sort(F.concat(q(base_name), added)))).drop(extra)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda name: F.size(F.filter("secrets_base", lambda x: x["kind"] == name)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(F.col("secrets_base")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
