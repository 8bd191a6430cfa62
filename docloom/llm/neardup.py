"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Texts are A-Z lower-cased words between white space; a document's set has its distinct runs of `width` words, or its
whole word sequence if that is shorter. Texts of equal word sequences are one representative from the start.

Signatures (Li and Li, 2021): one permutation scatters the shingles over a circle of 2**CIRCLE places, a second gives
every place its rank; coordinate k is the least rank of the shingles' places shifted by k. So a shingle's ranks for all coordinates lie
side by side, and two permutations give the whole signature. BANDS bands of ROWS coordinates are the buckets: a pair at
the limit (0.85) shares none of them with a chance of (1 - 0.85**5)**30 = 2e-8.

A bucket is never expanded into all its pairs. In each round, the documents of a bucket that still holds more than one
component are compared with a pivot or with the others of a small chunk; links that the full sets confirm merge
components, and buckets all of one component drop out:
- in the first round, the pivot is the document with most bucket mates over all bands: the middle of a group of copies,
  to which all link that link to each other through what the group shares;
- in later rounds, chunks of about CHUNK documents or CHUNK_BYTES bytes, dealt anew for each round and band, hold every
  pair of a small bucket, and of a large one pairs that the pivots don't join. Documents that share passages of their
  own share small buckets. In a chunk, all pairs' intersections are one product of small tables, and only links that
  join components leave it.
- buckets of more than one chunk go on alone, in chunks dealt anew up to round ROUNDS while a round still joins an eighth of
  their components or more; then those still open are compared whole: the members outside the pivot's component in blocks of about BLOCK documents or
  BLOCK_BYTES bytes, each block with itself, with each other one and with each block of the pivot's component.
So every pair that shares a bucket is compared by its full sets unless it is of one component already, however large the
bucket. The last step's work grows with the square of the number of members that nothing joins. Before the full sets of a pivot's
pairs are compared, pairs whose signatures rule the limit out (by more than six standard deviations) are left out.

Components are merged by contraction: each component joins its neighbour of least random rank, over and over, until no
edge between different ones is left; the result is the smallest doc_id. Rows are documents: those of one doc_id have
each its own links. Rows without a doc_id are linked with nothing, and have no component and a null `kept`. Null and empty texts have
empty sets and are linked with nothing. An empty table gives an empty table; other columns play no part.

Hot buckets and copies meet in partial aggregates, and copies find their group over many places; in all but the last step, pairs grow with bucket memberships, not with their squares.
Every table that is used twice is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import durable, q, read, sliced, spread_join, worker_cache

BANDS, ROWS = 30, 5
CIRCLE = 20
CHUNK, CHUNK_BYTES = 256, 400_000  # documents and bytes of text, about
ROUNDS = 4
BLOCK, BLOCK_BYTES = 1024, 2_000_000  # as CHUNK, of one side of a comparison
SLAB = 4096  # shingles of a table at a time
WIDTH, LIMIT = 5, 80  # words in a shingle, per cent
CACHE = 300_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes.lower and bytes.split know ASCII only


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(word)
        return n


def shingles(words: list[bytes], width: int, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter((hashes[w] for w in words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    out ^= out >> np.uint64(32)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _circle(coordinates: int) -> np.ndarray:
    """Rows of `coordinates` consecutive ranks, one row for each place of the circle."""
    ranks = np.random.default_rng(20_240_601).permutation(1 << CIRCLE).astype(np.uint32)
    return sliding_window_view(np.concatenate([ranks, ranks[:coordinates]]), coordinates)


def signature(own: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The first permutation is a bijection of the shingles' hashes, of which the top bits are the place."""
    places = (own * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - CIRCLE)).astype(np.int64)
    circle, least = _circle(coordinates), np.full(coordinates, 1 << CIRCLE, dtype=np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(least, circle[places[at : at + 2048]].min(axis=0), out=least)
    return least


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("shingle words", Hashes)
        for piece in sliced(batches):
            digests, sizes, bands, sketches = [], [], [], []
            for text in piece.column("text").to_pylist():
                words = words_of(text)
                own = shingles(words, width, hashes)
                sizes.append(len(own))
                if not len(own):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                s = signature(own)
                keys = [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(s.reshape(BANDS, ROWS))]
                bands.append(keys), sketches.append((s * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), piece.column("text")],
                names=["id", "digest", "n", "bands", "sketch", "text"],
            )

    return run


def _least(limit: int) -> float:
    """Fewer equal sketch bytes than this rule the limit out, by more than six standard deviations."""
    k, p = BANDS * ROWS, limit / 100
    return k * (p - 6 * (p * (1 - p) / k) ** 0.5)


def _alike(limit: int):
    """Lets the pairs pass whose sketches don't rule the limit out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BANDS * ROWS) for c in ("sketch_a", "sketch_b"))
                keep = pa.array((a == b).sum(axis=1) >= _least(limit))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _spanning(comp: list[int], linked: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Of links between places, those that join components not joined yet."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    for i, j in linked:
        a, b = top(comp[i]), top(comp[j])
        if a != b:
            up[a] = b
            yield i, j


def _chunk_links(width: int, limit: int):
    """Of each row's nodes, links that join their components, from the full sets of all pairs.

    The sets are rows of a table over the chunk's shared shingles; its product with itself has the intersections' sizes.
    Where there are two sides, only pairs of different sides are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("shingle words", Hashes)
        for batch in sliced(batches, 10):
            left, right = [], []
            for nodes, comps, sides, texts in zip(*(batch.column(c).to_pylist() for c in ("nodes", "comps", "sides", "texts"))):
                sets = [shingles(words_of(t), width, hashes) for t in texts]
                sizes, comp = np.array([len(x) for x in sets]), np.array(comps)
                side = np.array(sides)
                if side.any() and not side.all():
                    few, all_ = np.flatnonzero(~side), np.flatnonzero(side)
                else:
                    kinds, of = np.unique(comp, return_inverse=True)
                    few = np.flatnonzero(of != np.bincount(of, minlength=len(kinds)).argmax())  # the largest component's own pairs are joined already
                    all_ = np.arange(len(sets))
                _, column = np.unique(np.concatenate(sets), return_inverse=True)
                row, shared = np.repeat(np.arange(len(sets)), sizes), np.bincount(column) > 1
                column, row = (np.cumsum(shared) - 1)[column][shared[column]], row[shared[column]]
                order = np.argsort(column, kind="stable")
                column, row = column[order], row[order]
                both = np.zeros((len(few), len(all_)), dtype=np.float32)
                for at in range(0, int(shared.sum()), SLAB):
                    lo, hi = np.searchsorted(column, [at, at + SLAB])
                    table = np.zeros((len(sets), min(SLAB, int(shared.sum()) - at)), dtype=np.float32)
                    table[row[lo:hi], column[lo:hi] - at] = 1
                    both += table[few] @ table[all_].T
                both = both.astype(np.int64)
                alike = (100 * both >= limit * (sizes[few][:, None] + sizes[all_][None, :] - both)) & (comp[few][:, None] != comp[all_][None, :])
                linked = np.argwhere(alike)
                linked = np.stack([few[linked[:, 0]], all_[linked[:, 1]]], axis=1)
                for i, j in _spanning(comps, map(tuple, linked.tolist())):
                    left.append(min(nodes[i], nodes[j])), right.append(max(nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _confirm(width: int, limit: int):
    """Rows of one pivot `a` with its text and texts that may be linked to it: lets the linked pairs pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, mine = worker_cache("shingle words", Hashes), None, None
        for batch in sliced(batches, 200):
            a, b, left, right = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = []
            for i in range(len(a)):
                if mine is None or a[i] != last:
                    last, mine = a[i], shingles(words_of(left[i]), width, hashes)
                other = shingles(words_of(right[i]), width, hashes)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= limit * (len(mine) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, comp) after edges(x, y) between components; comp becomes some member of the merged component."""
    edges = durable(edges.filter("x <> y").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min_by("y", F.xxhash64("y")).alias("to"))
        step = durable(least.filter(F.xxhash64("to") < F.xxhash64("x")).select(F.col("x").alias("was"), "to"))
        move = lambda df, c: df.join(step.withColumnRenamed("was", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = durable(move(labels, "comp").select("node", "comp"))
        edges = durable(move(move(edges, "x"), "y").filter("x <> y").select("x", "y").distinct())
    return labels


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets with more than one component, with their bucket's size and pivot; large buckets over many places."""
    now, best = buckets.join(labels, "node"), F.col("score")
    state = now.groupBy("band", "key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes_all"), F.max_by("node", best).alias("pivot"), F.max_by("comp", best).alias("pivot_comp"), F.max_by("n", best).alias("pivot_n")
    )
    state = durable(state.filter("low <> high").drop("low", "high"))
    return spread_join(now, state, ["band", "key"], "node", "size", state.agg(F.sum("size")).first()[0] or 0).filter("size IS NOT NULL")


def _star_pairs(buckets: DataFrame, labels: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    """Distinct (a, b) to try: each member with its bucket's pivot."""
    members = _open(buckets, labels)
    near = 100 * F.least("n", "pivot_n") >= limit * F.greatest("n", "pivot_n")  # sets of very different sizes are never alike
    stars = members.filter((F.col("comp") != F.col("pivot_comp")) & near).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return _side(_side(stars, sets, "a", "sketch"), sets, "b", "sketch").mapInArrow(_alike(limit), "a long, b long")


def _mate_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame, turn: int, width: int, limit: int) -> DataFrame:
    """Links (a, b) within chunks of the open buckets' members."""
    members = _open(buckets, labels)
    chunks = F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("bytes_all") / CHUNK_BYTES))
    own = members.select("band", "key", F.pmod(F.xxhash64("node", "band", F.lit(turn)), chunks).alias("chunk"), "node", "comp").join(sets.select("node", "text"), "node")
    return _links(own.withColumn("side", F.lit(False)), ["band", "key", "chunk"], width, limit)


def _block_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame, width: int, limit: int) -> DataFrame:
    """Links (a, b) of all pairs of different components in the open buckets.

    Blocks 0 to `free` - 1 have the members outside the pivot's component, the others those within.
    """
    members = _open(buckets, labels).withColumn("out", F.col("comp") != F.col("pivot_comp"))
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.sum(of.cast("long")) / BLOCK), F.ceil(F.sum(F.when(of, F.col("bytes"))) / BLOCK_BYTES)).cast("int")
    counts = members.groupBy("band", "key").agg(blocks(F.col("out")).alias("free"), blocks(~F.col("out")).alias("held"))
    dealt = members.select("band", "key", "node", "comp", "out").join(counts, ["band", "key"]).join(sets.select("node", "text"), "node")
    hashed = F.xxhash64("node", "band")
    dealt = dealt.withColumn("block", F.when(F.col("out"), F.pmod(hashed, F.col("free"))).otherwise(F.col("free") + F.pmod(hashed, F.col("held"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("out"), F.col("free") + F.col("held")).otherwise(F.col("free")) - 1)
    own = dealt.withColumn("with", F.explode(meets)).select("band", "key", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block", "node", "comp", "text")
    return _links(own.withColumn("side", F.col("block") > F.col("left")), ["band", "key", "left", "right"], width, limit)


def _links(own: DataFrame, by: list[str], width: int, limit: int) -> DataFrame:
    lists = own.groupBy(*by).agg(F.collect_list(F.struct("node", "comp", "side", "text")).alias("own"))
    lists = lists.filter(F.size("own") > 1).select(*[F.col(f"own.{c}").alias(f"{c}s") for c in ("node", "comp", "side", "text")])
    return lists.mapInArrow(_chunk_links(width, limit), "a long, b long").distinct()


def _components(buckets: DataFrame, labels: DataFrame) -> int:
    return buckets.select("node").distinct().join(labels, "node").select("comp").distinct().count()


def _side(pairs: DataFrame, sets: DataFrame, of: str, column: str) -> DataFrame:
    return pairs.join(sets.select(F.col("node").alias(of), F.col(column).alias(f"{column}_{of}")), of)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(q(doc_id).alias("id"), q(text).alias("text"))
    signed = durable(base.mapInArrow(_sign(width), f"id {kind}, digest binary, n long, bands array<long>, sketch binary, text string"))
    known = signed.filter("digest IS NOT NULL AND id IS NOT NULL")
    reps = durable(known.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    rows = known.select("digest", "id", "n", F.octet_length("text").alias("bytes"), "bands").join(reps, (known["digest"] == reps["digest"]) & (F.col("id") == F.col("rep"))).select("node", "n", "bytes", "bands").dropDuplicates(["node"])
    rows = durable(rows.select("node", "n", "bytes", F.posexplode("bands").alias("band", "key")))
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes_all")).filter("size > 1")
    large = (F.col("size") > CHUNK) | (F.col("bytes_all") > CHUNK_BYTES)  # more than one chunk
    buckets = durable(rows.join(sizes.withColumn("large", large).drop("bytes_all"), ["band", "key"]))
    # How many mates a node has over all bands, with a hash below it to tell apart equal ones.
    scores = buckets.groupBy("node").agg((F.sum("size") * (1 << 16) + F.pmod(F.xxhash64("node"), F.lit(1 << 16))).alias("score"))
    buckets = durable(buckets.drop("size").join(scores, "node"))
    labels = durable(scores.select("node", F.col("node").alias("comp")))
    own = known.select("digest", "id", "sketch", "text").join(reps, (known["digest"] == reps["digest"]) & (F.col("id") == F.col("rep"))).select("node", "sketch", "text")
    sets = durable(own.join(labels.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def merged(links: DataFrame) -> DataFrame:
        edges = durable(links)
        for c, to in (("a", "x"), ("b", "y")):
            edges = edges.join(labels.select(F.col("node").alias(c), F.col("comp").alias(to)), c)
        return merge(labels, durable(edges.select("x", "y")))

    pairs = _star_pairs(buckets, labels, sets, limit)
    labels = merged(_side(_side(pairs, sets, "b", "text"), sets, "a", "text").mapInArrow(_confirm(width, limit), "a long, b long"))
    rest = durable(buckets.filter("large"))  # all pairs of the others are compared in the first turn
    free = _components(rest, labels)
    labels = merged(_mate_links(buckets, labels, sets, 1, width, limit))
    for turn in range(2, ROUNDS):
        before, free = free, _components(rest, labels)
        if 8 * free >= 7 * before:
            break
        labels = merged(_mate_links(rest, labels, sets, turn, width, limit))
    if free:
        labels = merged(_block_links(rest, labels, sets, width, limit))
    comps = labels.join(reps, "node").select("digest", "comp", "rep")
    least = comps.groupBy("comp").agg(F.min("rep").alias("least"))
    linked = comps.join(least, "comp").select("digest", "least")
    of = reps.join(linked, "digest", "left").select("digest", "copies", F.coalesce("least", "rep").alias("component_id"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    # Rows without a digest are dealt by their id: they match nothing.
    rows = signed.select("id", F.coalesce("digest", F.col("id").cast("string").cast("binary"), F.lit(b"")).alias("digest"), "n")
    out = spread_join(rows, of, "digest", "id", "copies", signed.count()).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, limit=85)


SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
    SELECT doc_id, doc_id AS r FROM d
    UNION
    SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.r
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
