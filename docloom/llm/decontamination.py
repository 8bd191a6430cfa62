"""Benchmark decontamination: token windows of the training texts against a broadcast set of test n-grams.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII, with A-Z lower-cased. An item's
windows are its runs of 10 words; an item of fewer words, but not none, is one window. The items' windows
are broadcast as a table from the words to numbers and one from hashes of windows to the windows; a document's words
are looked up, hashes of its windows are found in the set, and every hit is verified word by word before it counts.

Only items of together at most BROADCAST_BYTES bytes of text are broadcast. A larger benchmark stays distributed: its windows'
hashes make a bitmap of a fixed 32 MB, which is broadcast instead; what passes it of the documents' windows is
joined to the items' windows, by their words, with one pass over the documents however large the benchmark is. Windows that
many documents have are dealt over many places.

Null text has no words, and neither has null item text; such items occur nowhere. Items of one id are one item; the
words of an item without an id are hit, but it is not listed. Repeated rows each get the same result; documents without
words stay, with zeros. An empty table gives an empty table, an empty benchmark no hits. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import durable, fresh, let, q, read, running, sliced, spread_join

N = 10
BROADCAST_BYTES = 8 << 20
BITS = 28
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")  # of UTF-8, in which all characters beyond ASCII have such bytes only


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []  # bytes.lower changes A-Z only


class Windows:
    """The windows of some items: `number` of each word, and by length the sorted hashes of the windows with all their owners."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(n, len(own))
            for i in range(len(own) - size + 1) if size else ():
                owners[tuple(own[i : i + size])].update([item] if item is not None else [])
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list]]] = {}
        for size in sorted({len(w) for w in owners}):
            table: dict[int, list] = defaultdict(list)
            for window in owners:
                if len(window) == size:
                    table[int(self.hashes(np.array(window, dtype=np.uint64), size)[0])].append((np.array(window, dtype=np.int64), sorted(owners[window])))
            self.by_length[size] = (np.array(sorted(table), dtype=np.uint64), dict(table))

    @staticmethod
    def hashes(numbers: np.ndarray, size: int) -> np.ndarray:
        """A polynomial hash of each run of `size` numbers."""
        out = np.zeros(len(numbers) - size + 1, dtype=np.uint64)
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + len(out)] * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))

    def hits(self, text: str | None) -> tuple[int, list[int], list[int], set[str]]:
        """How many words the text has, begins and ends (exclusive) of the joined hit runs, and the items that occur."""
        words = words_of(text)
        number = self.number.get
        numbers = np.fromiter((number(w, 0) for w in words), dtype=np.int64, count=len(words))
        known = numbers > 0
        found: set[str] = set()
        if not known.any():
            return len(words), [], [], found
        hit = np.zeros(len(words) + 1, dtype=np.int64)
        unknown = np.concatenate([[0], np.cumsum(~known)])
        for size, (hashes, table) in self.by_length.items():
            if len(words) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            own = self.hashes(numbers.astype(np.uint64), size)[starts]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            for i in np.flatnonzero(hashes[at] == own):
                start = int(starts[i])
                for window, items in table[int(own[i])]:
                    if np.array_equal(window, numbers[start : start + size]):
                        hit[start] += 1
                        hit[start + size] -= 1
                        found.update(items)
        inside = np.diff(np.concatenate([[0], np.cumsum(hit[:-1]) > 0, [0]]).astype(np.int8))
        return len(words), np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), found


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 50):
        items, windows, hashes, sizes = [], [], [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            size = min(N, len(words))
            own = Windows.hashes(_word_hashes(words), size) if size else ()
            for i, h in enumerate(own):
                items.append(item), windows.append(b" ".join(words[i : i + size])), hashes.append(int(h) - (1 << 63)), sizes.append(size)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32())], names=["item", "window", "hash", "size"])


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The hashes that occur, as 2**BITS bits; the driver gets them in pieces of 4 KB that were put together by the tasks."""
    bit = F.pmod("hash", F.lit(1 << BITS)) + 1
    pieces = windows.groupBy(F.bitmap_bucket_number(bit).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((1 << BITS) // 8, dtype=np.uint8)
    for r in pieces:  # numbered from 1
        own = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[(r["piece"] - 1) * len(own) : r["piece"] * len(own)] = own
    return out


def _candidates(shared, sizes: list[int], row: str, text: str):
    """(row, start, size, window) of the windows whose hashes the bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in sliced(batches, 50):
            rows, starts, lengths, windows = [], [], [], []
            for i, body in enumerate(batch.column(text).to_pylist()):
                words = words_of(body)
                own = _word_hashes(words)
                for size in sizes:
                    if len(words) >= size:
                        at = (Windows.hashes(own, size) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
                        for start in np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                            rows.append(i), starts.append(start), lengths.append(size), windows.append(b" ".join(words[start : start + size]))
            yield pa.RecordBatch.from_arrays([batch.column(row).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(windows, pa.binary())], names=["row", "b", "size", "window"])

    return run


def benchmark_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of docs and n_words, n_hit, hit_begins, hit_ends (in words) and hit_items (sorted strings)."""
    spark = docs.sparkSession
    names = fresh(docs, "n_words", "n_hit", "hit_begins", "hit_ends", "hit_items", "decon_row")
    out, row = names[:5], names[5]
    kinds = ["long", "long", "array<long>", "array<long>", "array<string>"]

    def scan(df: DataFrame, own: list) -> DataFrame:
        shared, columns = spark.sparkContext.broadcast(Windows(own)), df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in sliced(batches):
                rows = [windows.hits(t) for t in batch.column(columns.index(text)).to_pylist()]
                more = [pa.array([r[0] for r in rows], pa.int64()), pa.array([sum(r[2]) - sum(r[1]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([sorted(r[3]) for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *out])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` {k}" for c, k in zip(out, kinds))])
        return df.mapInArrow(run, schema)

    own = items.select(q(item_id).cast("string").alias("item"), q(item_text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= broadcast_bytes:
        return scan(docs, [tuple(r) for r in own.filter("text <> ''").collect()])
    windows = durable(own.mapInArrow(_item_windows, "item string, window binary, hash long, size int"))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most N
    numbered = durable(scan(docs.withColumn(row, F.monotonically_increasing_id()), []).drop(*out[1:]))
    bits = spark.sparkContext.broadcast(_bitmap(windows))
    found = durable(numbered.select(row, q(text)).mapInArrow(_candidates(bits, sizes, row, text), "row long, b long, size long, window binary"))
    owners = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    owners = owners.join(found.groupBy("window").agg(F.count(F.lit(1)).alias("times")), "window")
    hits = spread_join(found, owners, "window", "row", "times", found.count()).filter("items IS NOT NULL")
    span = F.struct("b", (F.col("b") + F.col("size")).alias("e"))
    merged = hits.groupBy("row").agg(F.collect_set(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = merged.select(F.col("row").alias(row), _united(F.col("spans")).alias("spans"), "items")
    merged = merged.select(row, F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["b"]).alias(out[1]), F.col("spans.b").alias(out[2]), F.col("spans.e").alias(out[3]), F.col("items").alias(out[4]))
    nothing = [F.coalesce(q(c), F.lit(0) if k == "long" else F.array().cast(k)).alias(c) for c, k in zip(out[1:], kinds[1:])]
    return numbered.join(merged, row, "left").select(*[q(c) for c in docs.columns], out[0], *nothing)


def _united(spans: Column) -> Column:
    """Spans that meet are one: a span begins where it is beyond the ends of all before it, and ends before the next that does."""
    kind = "struct<b:bigint,before:bigint,e:bigint>"
    seen = running(F.array_sort(spans), F.lit(-1).cast("long"), lambda far, x: F.greatest(far, x["e"]), lambda far, x: F.struct(x["b"].alias("b"), far.alias("before"), F.greatest(far, x["e"]).alias("e")), kind)
    first = lambda a: F.filter(a, lambda x: x["b"] > x["before"])
    last = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["b"] > x["e"], F.lit(True)))
    return let(seen, lambda a: F.zip_with(first(a), last(a), lambda x, y: F.struct(x["b"].alias("b"), y["e"].alias("e"))))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no benchmark window occurs in, with their own columns."""
    found = benchmark_hits(docs, items, text)
    n_hit = found.columns[len(docs.columns) + 1]
    return found.filter(q(n_hit) == 0).select(*[q(c) for c in docs.columns])


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS g
    FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
),
own AS (
    SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
),
hits AS (SELECT doc_id, p, own.k, item FROM own JOIN windows ON own.g = windows.g AND own.k = windows.k),
words AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
