"""Contiguous shards of nearly equal bytes, by global prefix sums from per-range totals.

Rows are in the order of their range of doc_id (nulls first), then of doc_id, size and checksum. Ranges give totals of bytes and rows; from
these the driver has each range's offset, and running sums within the ranges give each row's place among all bytes. With
T bytes and n shards, a row that begins at byte p goes to shard p * n div T, in whole numbers: every shard is within one
row of an equal share, and no row begins at T, so shards are 0 to n - 1 at any size. This is the `bytes` law;
`grown_shard` is therefore null. A table of 2**63 / n bytes or more is an arithmetic error, not a wrong shard.

A row's size is its text's UTF-8 bytes plus 1; null text has no bytes and checksum 0; a very long text is one row like
others, and the shard it begins in is the larger for it. Repeated rows and rows with equal doc_id each get their own
slot. An empty table gives an empty table. Other columns play no part.

A doc_id, or null, that fills more than two ranges is dealt over SPLIT ranges by the rows' checksums, so that only equal
rows are bound to one task. Only (doc_id, size, checksum) are shuffled, once, and written once to the shared folder; the
driver holds two numbers a range and one a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import durable, partitions, q, range_bounds, range_bucket, read

SHARDS = 8
SPREAD = 4  # ranges to each shuffle partition
SPLIT = 64  # a power of two


def shard_of(begins: Column, shards: int, total: int) -> Column:
    """Whole-number division of longs: no rounding, whatever the total."""
    return F.call_function("div", begins.cast("bigint") * F.lit(shards).cast("bigint"), F.lit(total).cast("bigint")).cast("int")


def shard_bytes(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", size: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. `size`: another measure of a row than its text's bytes and 1, above 0."""
    spark = docs.sparkSession
    bounds, hot = range_bounds(docs, doc_id, SPREAD * partitions(spark))
    own = F.coalesce(F.octet_length(q(text)), F.lit(0)).cast("long") + 1 if size is None else size.cast("long")
    slim = docs.select(q(doc_id).alias("doc_id"), own.alias("size"), F.crc32(F.coalesce(q(text), F.lit("")).cast("binary")).alias("text_crc32"), range_bucket(q(doc_id).cast("bigint"), bounds).alias("range"))
    place = F.when(F.col("range").isin(hot), F.shiftright("text_crc32", 32 - (SPLIT.bit_length() - 1)).cast("int")).otherwise(0)
    slim = slim.withColumn("range", F.col("range") * SPLIT + place)
    order = Window.partitionBy("range").orderBy("doc_id", "size", "text_crc32")
    within = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = durable(slim.withColumns({"bytes": F.sum("size").over(within), "rank": F.row_number().over(order)}))
    totals = {r["range"]: (r["bytes"], r["rows"]) for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    ranges = (len(bounds) + 1) * SPLIT
    before = np.zeros((ranges + 1, 2), dtype="int64")
    for i in range(ranges):
        before[i + 1] = before[i] + totals.get(i, (0, 0))
    total = max(1, int(before[-1][0]))
    offset = lambda k: F.get(F.lit(before[:, k].copy()), F.col("range"))
    begins = F.col("bytes") - F.col("size") + offset(0)
    cut = placed.select("doc_id", "size", "text_crc32", shard_of(begins, shards, total).alias("shard"), (F.col("rank") - 1 + offset(1)).alias("place"))
    starts = {r["shard"]: r["first"] for r in cut.groupBy("shard").agg(F.min("place").alias("first")).collect()}
    first = F.lit(np.array([starts.get(i, 0) for i in range(shards)], dtype="int64"))
    return cut.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.get(first, F.col("shard"))).cast("long").alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = shard_bytes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The checksum is that of the rule (reflected polynomial 0xEDB88320), a byte at a time.
SQL = """
WITH bits AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT doc_id, size, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM d),
sums AS (SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM bytes, bits),
placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, sum(size) OVER () AS total FROM sums),
cut AS (SELECT *, CAST(begins * 8 // total AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
