"""Personal data by candidate gradient boosting, with DataFrame functions only.

Generators of high recall propose spans that may overlap: written-out mail addresses, digits with separators, bare
runs of digits, account numbers, and addresses of hexadecimal groups. Whole-number features of a candidate's format and of the text just
before and after it go to boosted trees (boosting.py), which are one expression of comparisons. Calibrated thresholds select
candidates; selected ones that overlap spans of the base formats, which always stay, are left out, and of those that
overlap each other the more probable stays (then the first), settled by a sweep in order of place: no pairs are compared.

The trees are fitted on EXAMPLES made-up sentences, whose features come from the same expressions; there are no labels for this
in the corpus. Their number is the bound on what the driver fits.

Null text counts as empty; an empty text has no spans; repeated rows each get the same result; an empty table gives an
empty table; other columns pass through, and the results' names give way to theirs. The work is one pass over each row:
no shuffle, and nothing is gathered from the corpus.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.boosting import Boosted, fit
from docloom.llm.common import fresh, joined, let, matches, q, reach, read, running

# The base formats. Loops that need no way back are possessive, and a run is tried at its start only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# The generators.
GENERATORS = {
    "email_like": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    "number_like": r"(?<![A-Za-z0-9.])\+?\(?[0-9]{1,20}+(?:[\x20./()-]{1,2}+[0-9]{1,20}+)++(?![A-Za-z0-9])",
    "account_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])",
    "digit_run": r"(?<![A-Za-z0-9.,_$€£#+-])[0-9]{7,20}+(?![A-Za-z0-9_])",
    "hex_groups": r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])",
}
BEFORE, AFTER = 28, 12
# Words that speak for kinds of personal data, and against.
HINTS = {
    "mail": r"(?i)(?:mail|contact|write|reach|address)",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|contact|reach|ring)",
    "number": r"(?i)(?:ssn|social security|passport|licen[cs]e|national id|identity|insurance|tax id|iban|account|acct|card|visa|born|birth|dob|patient|member)",
    "network": r"(?i)(?:\bip\b|ipv6|host|server|client|mac|address|login)",
    "other": r"(?i)(?:version|release|price|total|pages?|chapter|section|score|figure|table|isbn|issn|order|invoice|ticket|issue|build|serial|sku|item|part|model|time|seconds|population|about|ratio|lines?|bytes|usd|eur|[$€£#]|at)\W{0,3}(?:no\.?|number|is|of)?\W{0,2}$",
}
EXAMPLES = 2400


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    digit = lambda i: F.substring(digits, n - i, 1).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, twice(digit(i))).otherwise(digit(i))) % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _base(text: Column) -> list[tuple[str, Column]]:
    n = lambda x: F.char_length(_digits(x["m"]))
    return [
        ("email", matches(text, EMAIL)),
        ("ip", F.filter(matches(text, IP), lambda x: x["m"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))),
        ("card", F.filter(matches(text, CARD), lambda x: F.when(n(x).between(13, 19), luhn(_digits(x["m"]))).otherwise(False))),
        ("phone", F.filter(matches(text, PHONE), lambda x: n(x).between(9, 15))),
    ]


def _features(generator: int, x: Column) -> list[Column]:
    """Whole numbers only, so that trees cut them the same everywhere."""
    m = x["m"]
    count = lambda pattern: F.char_length(F.regexp_replace(m, pattern, ""))
    has = lambda column, pattern: column.rlike(pattern).cast("int")
    return [
        F.lit(generator),
        F.char_length(m),
        count("[^0-9]"),
        count("[0-9A-Za-z]"),
        count("[^A-Za-z]"),
        F.size(F.split(m, "[^0-9A-Za-z]+")),
        has(m, r"^\+"),
        has(m, r"^\(?[0-9]{3}\)?[\x20./-][0-9]{3}[\x20./-][0-9]{4}$"),
        has(m, r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        has(m, r"^(?:[12][0-9]{3}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:[12][0-9])?[0-9]{2})$"),
        has(m, r"^[0-9]+(?:\.[0-9]+)+$"),
        has(m, r"[\[({](?:at|dot)[\])}]|\x20at\x20.*\x20dot\x20"),
        has(m, r"^[A-Z]{2}[0-9]{2}"),
        *[has(x["before"], p) for p in HINTS.values()],
        has(x["after"], r"^\x20?(?:%|percent|pages|km|kg|mm|ms|MB|GB|usd|eur|\$|€)"),
        has(x["before"], r"[A-Za-z]\x20?$"),
    ]


def _candidates(text: Column, then) -> Column:
    """Candidates of all generators, each as then(kind, generator, candidate)."""
    each = [F.transform(matches(text, pattern, BEFORE, AFTER), _bound(then, kind, i)) for i, (kind, pattern) in enumerate(GENERATORS.items())]
    return F.concat(*each)


def _bound(then, kind: str, i: int):
    return lambda x: then(kind, i, x)


def examples(n: int, seed: int = 7) -> list[tuple[str, int]]:
    """Made-up sentences with one candidate or more; 1: all of these are personal data."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
    hexs = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    sep = lambda: rnd.choice([" ", "-", "."])
    at, dot = lambda: rnd.choice([" (at) ", "[at]", " at ", "{at}"]), lambda: rnd.choice([" (dot) ", "[dot]", " dot "])
    yes = [
        lambda: (rnd.choice(["call ", "phone: ", "tel. ", "mobile ", "fax ", "reach me on "]), (s := sep()) and f"{d(3)}{s}{d(3)}{s}{d(4)}"),
        lambda: (rnd.choice(["call ", "phone ", "contact ", word() + " "]), f"({d(3)}) {d(3)}-{d(4)}"),
        lambda: (rnd.choice(["tel ", "phone "]), f"0{d(2)} {d(4)} {d(4)}"),
        lambda: (rnd.choice(["ssn ", "social security number ", "her ssn is "]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (rnd.choice(["born ", "date of birth ", "dob: "]), f"{rnd.randint(1, 28):02d}/{rnd.randint(1, 12):02d}/19{d(2)}"),
        lambda: (rnd.choice(["mail ", "write to ", word() + " ", "contact "]), f"{word()}{at()}{word()}{dot()}{rnd.choice(['com', 'org', 'net'])}"),
        lambda: (rnd.choice(["iban ", "account ", "pay to "]), f"{rnd.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
        lambda: (rnd.choice(["client ", "ipv6 ", "host address "]), ":".join(hexs(4) for _ in range(8))),
        lambda: (rnd.choice(["call ", "phone ", "mobile: ", "tel ", "text me at phone "]), rnd.choice(["0", "1", ""]) + d(10)),
        lambda: (rnd.choice(["ssn ", "passport no ", "passport ", "tax id ", "national id number ", "insurance "]), d(9)),
        lambda: (rnd.choice(["account ", "acct no ", "card ", "account number is ", "member card "]), d(rnd.randint(10, 16))),
        lambda: (rnd.choice(["call ", "phone ", "mobile ", "ring "]), " ".join(d(2) for _ in range(5))),
        lambda: (rnd.choice(["phone ", "dial phone "]), " ".join(d(10))),
    ]
    no = [
        lambda: (rnd.choice(["version ", "release ", word() + " "]), ".".join(d(rnd.randint(1, 2)) for _ in range(rnd.randint(2, 4)))),
        lambda: (rnd.choice(["on ", "since ", word() + " "]), f"{rnd.choice(['19', '20'])}{d(2)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"),
        lambda: (rnd.choice(["on ", word() + " "]), f"{rnd.randint(1, 28)}/{rnd.randint(1, 12)}/{rnd.choice(['19', '20'])}{d(2)}"),
        lambda: (rnd.choice(["price $", "total ", "for "]), f"{d(2)}.{d(2)}"),
        lambda: (rnd.choice(["pages ", "lines ", "score "]), f"{d(2)}-{d(3)}"),
        lambda: (rnd.choice(["isbn ", "order #", "figure "]), f"{d(3)}-{d(1)}-{d(4)}-{d(3)}-{d(1)}"),
        lambda: (word() + " ", f"{word()} at {word()}.{rnd.choice(['', ' '])}{word()}"),
        lambda: (word() + " ", f"{d(3)} {d(3)} {d(3)}"),
        lambda: (rnd.choice(["at ", "until "]), f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
        lambda: (rnd.choice(["order ", "invoice no ", "ticket ", "build ", "serial ", "sku ", "item ", "part number ", word() + " ", "about "]), d(rnd.randint(7, 13))),
        lambda: (rnd.choice(["population ", "bytes ", "time ", word() + " "]), d(rnd.randint(7, 10))),
        lambda: (word() + " ", " ".join(d(rnd.randint(1, 3)) for _ in range(rnd.randint(3, 14)))),
        lambda: (rnd.choice(["figure ", "table ", "section "]), f"{d(1)}.{d(1)}-{d(2)}"),
        lambda: (word() + " ", f"{rnd.choice(['AB', 'XZ'])}{d(2)} {word().upper()[:4]} {word().upper()[:4]} {word().upper()[:3]}"),
    ]
    out = []
    for i in range(n):
        head, body = rnd.choice(yes if i % 2 else no)()
        out.append((f"{word()} {word()} {head}{body}{rnd.choice(['.', ',', ' ' + word(), ' and ' + word()])}", i % 2))
    return out


@lru_cache(maxsize=4)
def _fit(rows: tuple[tuple[int, ...], ...]) -> Boosted:
    table = np.array(rows)
    return fit(table[:, :-1], table[:, -1])


def train(spark: SparkSession, n: int = EXAMPLES) -> Boosted:
    """The features come from the expressions that the scan uses, over sentences in the plan itself."""
    texts = examples(n)
    both = F.explode(F.arrays_zip(F.lit([t for t, _ in texts]).alias("text"), F.lit([y for _, y in texts]).alias("y")))
    made = spark.range(1).select(both.alias("x")).select("x.text", "x.y")
    rows = made.select("y", F.explode(_candidates(F.col("text"), lambda kind, i, x: F.array(*[c.cast("int") for c in _features(i, x)]))).alias("f"))
    return _fit(tuple((*r["f"], r["y"]) for r in rows.collect()))  # about one candidate an example


def scan_pii(df: DataFrame, model: Boosted | None = None, text: str = "text") -> DataFrame:
    """Adds `pii_base` and `pii`: array<struct<rank,s,e,kind>> in order of kind, then start.

    Ranks follow the kinds: the base ones, then the generators'. `pii` has all base spans and the selected others.
    """
    model = model or train(df.sparkSession)
    base_name, all_name, extra = fresh(df, "pii_base", "pii", "pii_extra")
    body = F.coalesce(q(text), F.lit(""))
    span = lambda rank, kind: lambda x: F.struct(F.lit(rank).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))
    base = F.concat(*[F.transform(spans, span(rank, kind)) for rank, (kind, spans) in enumerate(_base(body))])

    def rated(kind: str, i: int, x: Column) -> Column:
        p = let(F.struct(*[c.alias(f"f{k}") for k, c in enumerate(_features(i, x))]), lambda f: model.column([f[f"f{k}"] for k in range(len(_features(i, x)))]))
        return F.struct(p.alias("p"), F.lit(len(BASE) + i).alias("rank"), x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))

    likely = F.filter(_candidates(body, rated), lambda x: x["p"] >= model.threshold)
    df = df.withColumns({base_name: F.array_sort(base), extra: likely})
    chosen = F.transform(_chosen(q(extra), q(base_name)), lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return df.withColumn(all_name, F.when(F.size(extra) == 0, q(base_name)).otherwise(F.array_sort(F.concat(q(base_name), chosen)))).drop(extra)


RATED = "struct<p:double,rank:int,s:int,e:int,kind:string>"


def _chosen(likely: Column, base: Column) -> Column:
    """Spans that overlap no base span, and of those that overlap each other the most probable, by two sweeps in order of place.

    The second one holds a span until one begins after its end; one that begins before takes its place if it is more
    probable (or as probable and of an earlier generator at the same start) and goes otherwise.
    """
    free = F.transform(F.filter(reach(likely, base, RATED, "e", 0), lambda x: x["far"] <= x["x"]["s"]), lambda x: x["x"])
    end = F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("rank"), F.lit(ENDS).alias("s"), F.lit(ENDS).alias("e"), F.lit("").alias("kind"))
    ordered = F.concat(F.array_sort(free, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["e"] - b["e"])), F.array(end))
    nothing = F.lit(None).cast(RATED)
    after = lambda held, x: held.isNull() | (x["s"] >= held["e"])
    held = running(ordered, nothing, lambda held, x: F.when(after(held, x) | (x["p"] > held["p"]), x).otherwise(held), lambda held, x: F.when(after(held, x), held), RATED)
    return F.array_compact(held)


BASE = ("email", "ip", "card", "phone")
ENDS = (1 << 31) - 1


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    n = lambda kind: F.size(F.filter("pii_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_pii(docs).select("doc_id", *map(n, BASE), F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
