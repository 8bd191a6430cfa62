import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm.sharding import op4_sharding, shard_bytes
from tests.llm.helpers import awkward, empty, sentences, written


def brute(rows):
    rows = sorted(((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), d) for d, t in rows))
    total, at, out, slots = sum(r[2] for r in rows), 0, [], [0] * 8
    for _, _, size, crc, d in rows:
        s = at * 8 // total
        out.append((d, size, crc, "bytes", s, slots[s], None))
        slots[s] += 1
        at += size
    return sorted(out, key=str)


def check(spark, df, path):
    got = op4_sharding(spark, written(df, path)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_awkward_rows(spark, tmp_path):
    check(spark, awkward(spark), tmp_path)


def test_empty(spark, tmp_path):
    assert op4_sharding(spark, written(empty(spark), tmp_path)).collect() == []


def test_many(spark, tmp_path):
    rows = list(enumerate(sentences(1, 500)))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)


@pytest.mark.parametrize("total", [10**9, 10**12, 10**15, 10**18])
def test_large_totals_end_in_the_last_shard(spark, total):
    """The last rows begin a few bytes before the end of all."""
    sizes = [total // 3] * 3 + [7, 1, 1, 1]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, bytes long, text string")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_bytes(df, size=F.col("bytes")).collect()}
    at, want, slots = 0, {}, [0] * 8
    for i, s in enumerate(sizes):
        shard = at * 8 // sum(sizes)
        want[i] = (shard, slots[shard])
        slots[shard] += 1
        at += s
    assert got == want and max(x for x, _ in got.values()) == 7


def test_a_hot_or_missing_id_is_dealt_over_many_ranges(spark):
    rows = [(None if i % 3 else 5, f"text {i}") for i in range(3000)] + [(i, f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_bytes(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text_crc32"]) for r in got) == sorted((d is None, d or 0, zlib.crc32(t.encode())) for d, t in rows)
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 8) < 20
