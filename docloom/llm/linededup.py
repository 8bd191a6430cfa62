"""Line dedup by all short runs of lines.

What repeats is a run of two lines or more with SHORT_WORDS words or more, or a line of LONG_WORDS words or more. Such a
run holds, with each of its lines that has a word, a chunk: a line that is long enough by itself; or, from a line that has
words, the shortest run of two lines and SHORT_WORDS words that begins, or ends, there. So all chunks are compared, none
is sampled, and the lines of the repeated chunks are the repeated runs at their full length, wherever they stand. A chunk of long
lines only adds nothing to these and is left out. Lines without a word that aren't in a chunk stay.

The chunk stays in the document with the smallest doc_id that has it, where it comes first, and every other occurrence
goes: within a document by direct comparison, across documents by 128-bit digests, which find the candidates, and then
comparison with the staying chunk's bytes. A candidate whose bytes differ stays. Chunks overlap, so that a line of a
staying chunk may go with another one, and of a line that follows itself over and over one is left; one copy of every
line always stays, since a line only goes where it stands in an earlier document or further up.

Null text stays null; empty text has one empty line and stays. A document may end up empty. Rows with equal doc_id are
one document, whose chunks don't go for each other's sake; rows without a doc_id lose their inner repeats only. Repeated
rows thus stay alike. An empty table gives an empty table; other columns pass through. A very long text is one row like others;
names that the new columns clash with make these end in underscores.

Only digests are grouped, with partial counts, so hot chunks meet as one row a partition, and where occurrences meet
the staying chunk, hot ones are dealt over many places. Rows without a doc_id stay where they are. Other texts are dealt by doc_id
once to meet what they may lose, and once more to give the staying chunks' bytes unless these documents' ids
are few enough (BROADCAST) to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import durable, fresh, q, read, sliced, spread_join

LONG_WORDS, SHORT_WORDS = 50, 8
BROADCAST = 200_000  # rows of 24 bytes


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(first line, end line, words) of the lines, of which the chunks that can be removed are made."""
    return [(i, i + 1, len(line.split())) for i, line in enumerate(text.split(b"\n"))]


def _runs(words: list[int]) -> list[tuple[int, int]]:
    """(first line, end line) of the chunks that can be removed, in order."""
    filled = [i for i, n in enumerate(words) if n]
    out = {(i, i + 1) for i in filled if words[i] >= LONG_WORDS}
    for step in (1, -1):
        order, at, n = filled[::step], 0, 0
        for k, i in enumerate(order):
            while at < len(order) and (at <= k or n < SHORT_WORDS):
                n += words[order[at]]
                at += 1
            if n >= SHORT_WORDS:
                j = order[at - 1] if at - 1 > k else i + step  # a line of enough words takes the next one, whatever it is
                if 0 <= j < len(words):
                    out.add((min(i, j), max(i, j) + 1))
            n -= words[i]
    return sorted((s, e) for s, e in out if e - s == 1 or min(words[s:e]) < LONG_WORDS)


def removable(text: str | None) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(digest, bytes, first line, end line) of the chunks that can be removed."""
    if text:
        lines = (body := text.encode()).split(b"\n")
        for start, end in _runs([n for _, _, n in chunks(body)]):
            own = b"\n".join(lines[start:end])
            yield xxhash.xxh3_128_digest(own), own, start, end


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows, digests = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = dict.fromkeys(d for d, *_ in removable(text))
            rows += [i] * len(own)
            digests += own
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int32())), pa.array(digests, pa.binary())], names=["id", "digest"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        digests, bodies = [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            own = {d: b for d, b, *_ in removable(text)}
            for d in wanted:
                if d in own:
                    digests.append(d), bodies.append(own[d])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names=["digest", "body"])


def without(text: str | None, others: set[bytes]) -> tuple[str | None, int, int]:
    """The text without repeats and without the chunks in `others`; its lines, and how many of them went."""
    if not text:
        return text, 0 if text is None else 1, 0
    lines, gone, seen = text.encode().split(b"\n"), set(), set()
    for _, body, start, end in removable(text):
        if body in others or body in seen:
            gone.update(range(start, end))
        seen.add(body)
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode() if gone else text, len(lines), len(gone)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, with the deduplicated text, and n_lines, n_removed (lines)."""
    columns, names = docs.columns, fresh(docs, "n_lines", "n_removed", "dedup_id", "dedup_gone")
    n_lines, n_removed, id_, gone = names
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(q(doc_id).alias("id"), q(text).alias("text"))
    found = durable(base.filter(F.col("id").isNotNull()).mapInArrow(_digests, f"id {kind}, digest binary"))
    repeated = durable(found.groupBy("digest").agg(F.min("id").alias("stays"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("stays < last").select("digest", "stays", "n"))
    wanted = repeated.groupBy(F.col("stays").alias("id")).agg(F.collect_list("digest").alias("wanted"))  # at most a document's chunks
    if repeated.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    bodies = durable(base.join(wanted, "id").select("text", "wanted").mapInArrow(_bodies, "digest binary, body binary").dropDuplicates(["digest"]))
    staying = repeated.join(bodies, "digest")
    goes = spread_join(found, staying, "digest", "id", "n", found.count()).filter("id <> stays")
    lost = goes.groupBy(F.col("id").alias(id_)).agg(F.collect_set("body").alias(gone))  # rows of one doc_id lose the same chunks

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for batch in sliced(batches):
            rows = [without(t, set(others or ())) for t, others in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist())]
            own = [batch.column(i) for i in range(len(columns))]
            own[at] = pa.array([r[0] for r in rows], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*own, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[*columns, n_lines, n_removed])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{n_lines}` long", f"`{n_removed}` long"])
    met = docs.filter(q(doc_id).isNotNull()).join(lost, q(doc_id) == q(id_), "left").select(*[q(c) for c in columns], gone)
    alone = docs.filter(q(doc_id).isNull()).select(*[q(c) for c in columns], F.lit(None).cast("array<binary>").alias(gone))
    return met.union(alone).mapInArrow(rewrite, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, text, lines, list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) AS ws
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
),
filled AS (
    SELECT r, i, n, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS n FROM d) WHERE n > 0
),
ends AS (SELECT r, i, upto, upto - n AS before, upto - n + {SHORT_WORDS} AS least, upto - {SHORT_WORDS} AS most FROM filled),
runs AS (
    SELECT r, i AS s, i AS e FROM filled WHERE n >= {LONG_WORDS}
    UNION
    SELECT a.r, a.i, greatest(b.i, a.i + 1) FROM ends a ASOF JOIN ends b ON a.r = b.r AND a.least <= b.upto
    UNION
    SELECT a.r, least(b.i, a.i - 1), a.i FROM ends a ASOF JOIN ends b ON a.r = b.r AND a.most >= b.before
),
chunks AS (
    SELECT r, doc_id, s, e, array_to_string(lines[s : e], chr(10)) AS body FROM runs JOIN d USING (r)
    WHERE s >= 1 AND e <= len(lines) AND (s = e OR list_min(ws[s : e]) < {LONG_WORDS})
),
met AS (SELECT r, s, e, doc_id, min(doc_id) OVER (PARTITION BY body) AS stays, row_number() OVER (PARTITION BY r, body ORDER BY s) AS nth FROM chunks),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s, e + 1)) AS i FROM met WHERE nth > 1 OR stays < doc_id) GROUP BY r)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END AS text
FROM d LEFT JOIN gone USING (r)
"""
