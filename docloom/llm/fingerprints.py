"""Document fingerprints by consistent weighted sampling (Ioffe, ICDM 2010), with DataFrame functions only.

A text's terms are its words, runs between white space, lower-cased, weighted by how often they occur. For each term t
and coordinate k, hashes of (t, k) give r and c from Gamma(2, 1) and beta from U(0, 1), the same in every document.
With q = floor(ln w / r + beta), the coordinate is the (t, q) for which ln c - r * (q - beta + 1) is least. The chance that
two texts agree in a coordinate is their generalised Jaccard similarity, sum(min(w)) / sum(max(w)). The least value
belongs to one (t, q) only, so 16 bits of its hash stand for the coordinate.

Equal texts have equal fingerprints. Null text counts as empty. A text without words has a fingerprint of dashes, which
agrees with another such text only. Documents follow each other by descending doc_id, nulls last, then by text; after
the last comes the first, so a table of one document follows itself; repeated rows follow each other. An empty table
gives an empty table. Columns that the query doesn't name play no part, whatever their names.

Texts are shuffled once, by ranges of doc_id, each of which is a partition of its own. A range also gets the first
document of the next range, so everything that follows (next text, word counts, samples, next fingerprint) stays in its
partition; words carry the row's number only, and what else belongs to the row rides on one of them. The driver holds one
doc_id a range. A very long text is one row like others, its words being counted in a table that spills.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import fresh, partitions, q, range_bounds, range_bucket, read

SIZE = 32
WORDS = r"[\x20\x09-\x0D]+"
SPREAD = 4  # ranges to each shuffle partition, so that hashing ranges to partitions deals them evenly


def _sample(term: Column, ln_weight: Column, k: int) -> Column:
    """ln a of Ioffe's a = c / (y * exp(r)) for one term and coordinate; the number also tells which (t, q) it is of.

    One hash gives four uniforms of 12 bits, whose products' logarithms are the gamma samples, and beta of 16 bits.
    """
    h = F.xxhash64(term.bitwiseXOR(F.lit(_salt(k))))
    uniform = lambda at, n: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int") + 0.5) / float(1 << n)
    r = -F.ln(uniform(0, 12) * uniform(12, 12))
    ln_c = F.ln(-F.ln(uniform(24, 12) * uniform(36, 12)))
    beta = uniform(48, 16)
    return ln_c - r * (F.floor(ln_weight / r + beta) - beta + 1)


def _salt(k: int) -> int:
    """Signed 64-bit constants, far apart in every bit: multiples of the golden ratio's fraction."""
    n = (k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return n - (1 << 64) if n >> 63 else n


def fingerprints(texts: DataFrame, keys: list[str], bodies: dict[str, str], carry: list[str] = [], size: int = SIZE) -> DataFrame:
    """`keys`, `carry` and, for each distinct value of the keys, a fingerprint of every text column: 4 hex digits a coordinate, or 4 dashes.

    bodies: from the fingerprints' names to the text columns. A term that several of a row's texts have is sampled
    once for all of them. Rows of equal keys are one bag of words; a null text has no words. `carry`: columns of whole
    numbers that rows of equal keys have in common. The caller may have dealt the rows by some of `keys`; no other
    exchange is then needed.
    """
    term, which, word, at = fresh(texts, "cws_term", "cws_which", "cws_word", "cws_at")
    names = list(bodies)
    lower = lambda c: F.translate(q(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda c: F.filter(F.split(F.coalesce(lower(c), F.lit("")), WORDS), lambda w: w != "")
    each = F.array(*[F.struct(F.lit(i).alias("i"), words(c).alias("w")) for i, c in enumerate(bodies.values())])
    terms = texts.select(*keys, *carry, F.explode(each).alias(which)).select(*keys, *carry, q(which)["i"].alias(which), F.posexplode_outer(q(which)["w"]).alias(at, word))
    once = (q(which) == 0) & (F.coalesce(q(at), F.lit(0)) == 0)
    terms = terms.select(*keys, *[F.when(once, q(c)).alias(c) for c in carry], which, F.when(q(word).isNotNull(), F.xxhash64(word)).alias(term))
    held = [F.max(c).alias(c) for c in carry]
    weights = [F.ln(F.sum(F.when((q(which) == i) & q(term).isNotNull(), 1).otherwise(0))).alias(f"cws_ln_{i}") for i in range(len(names))]
    counted = terms.groupBy(*keys, term).agg(*held, *weights)
    samples = [F.min(_sample(q(term), q(f"cws_ln_{i}"), k)).alias(f"cws_{i}_{k}") for k in range(size) for i in range(len(names))]

    def digits(least: Column) -> Column:
        return F.coalesce(F.lower(F.substring(F.hex(F.when(least.isNotNull(), F.xxhash64(least).bitwiseAND(F.lit(0xFFFF)) + 0x10000)), 2, 4)), F.lit("----"))

    prints = [F.concat(*[digits(q(f"cws_{i}_{k}")) for k in range(size)]).alias(name) for i, name in enumerate(names)]
    return counted.groupBy(*keys).agg(*held, *samples).select(*keys, *carry, *prints)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of coordinates in which two fingerprints agree."""
    same = lambda k: F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0)
    return sum((same(k) for k in range(size)), F.lit(0)) / F.lit(float(size))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and `next_text` of the next document, dealt by `part`, with `own` false on copies for the range before."""
    spark = docs.sparkSession
    bounds, _ = range_bounds(docs, doc_id, SPREAD * partitions(spark))
    last = len(bounds)
    slim = docs.select(q(doc_id).cast("bigint").alias("doc_id"), F.coalesce(q(text), F.lit("")).alias("text"))
    slim = slim.withColumn("part", range_bucket(F.col("doc_id"), bounds))  # a higher part has higher ids
    top = slim.agg(F.max("doc_id")).first()[0]
    # The first document of part p has the id bounds[p]; part p + 1 needs it, and part 0 needs the first of all.
    at_bound = F.get(F.lit(np.array([*bounds, 0], dtype="int64")), F.col("part")) == F.col("doc_id")
    first_of_all = F.col("doc_id").eqNullSafe(F.lit(top).cast("bigint"))
    to = lambda part, copy: F.struct(part.cast("int").alias("part"), F.lit(copy).alias("copy"))
    parts = F.array_compact(F.array(to(F.col("part"), 0), F.when((F.col("part") < last) & at_bound, to(F.col("part") + 1, 1)), F.when(first_of_all, to(F.lit(0), 2))))
    dealt = slim.select("doc_id", "text", F.explode(parts).alias("to")).select("doc_id", "text", "to.part", "to.copy")
    dealt = dealt.repartitionById(last + 1, F.col("part"))
    # A copy comes after the part's own rows; the first of all comes after even these.
    order = Window.partitionBy("part").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumns({"next_text": F.lead("text").over(order), "at": F.row_number().over(order)})


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.char_length("text")
    edited = F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 3), substring(next_text, 1, int(char_length(text) div 3)))")
    docs = docs.withColumn("edited", F.when(F.col("copy") == 0, F.when(n >= 3, edited).otherwise(F.col("text"))))
    sha = [f"sha_{i}" for i in range(4)]  # the digest as four whole numbers, which hash aggregates can hold
    docs = docs.select("part", "at", "copy", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), "text", "edited")
    quarters = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long").alias(c) for i, c in enumerate(sha)]
    bodies = docs.select("part", "at", "copy", "doc_id", "n_chars", *quarters, "text", "edited")
    both = fingerprints(bodies, ["part", "at"], {"fingerprint": "text", "edited_fingerprint": "edited"}, ["copy", "doc_id", "n_chars", *sha])
    both = both.withColumn("edited_sha256", F.when(F.col("sha_0").isNotNull(), F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in sha]))))
    following = both.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("part").orderBy("at")))
    return following.filter("copy = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
