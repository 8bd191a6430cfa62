"""Small tables with every awkward case, and plain versions of the contracts to hold the queries against."""

import random

LONG = "word " * 3000 + "end" * 5000


def awkward(spark):
    rows = [(1, "Hello world, this is a text.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "fr", "b"), (5, LONG, "en", "a"), (6, "Hello world, this is a text.", "en", "a"), (7, "é𝄞ü naïve 字符 ſK", "fr", "b"), (9, "x", "de", ""), (9, "x", "de", ""), (None, "no id here", "en", "c"), (8, None, None, None)]
    rows = [(*r, "clash", 0.5, 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string, term double, part int")


def empty(spark):
    return awkward(spark).filter("doc_id < 0")


def written(df, path, parts=3):
    """The table as documents.parquet in a folder, as the queries read it."""
    df.repartition(parts).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def sentences(seed, n, words=40):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, words))) for _ in range(n)]
