import hashlib
import re

import pytest

from docloom.llm import decontamination
from docloom.llm.decontamination import benchmark_hits, op8_decontamination
from tests.llm.helpers import awkward, empty, sentences, written

ITEMS = [(10, "One two three four five six seven eight nine ten eleven twelve"), (11, "short one"), (9, "x"), (12, None), (13, ""), (14, "..."), (10, "é ü ß"), (15, "short one"), (None, "secret item")]


def brute(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            own = words(text)
            size = min(n, len(own))
            for i in range(len(own) - size + 1) if size else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == own[i : i + size]:
                        hit.update(range(j, j + size))
                        if item is not None:
                            found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark, path, docs, items):
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return written(docs, path)


def documents(spark):
    texts = sentences(2, 60)
    texts[3] += " ONE two, three four five six seven eight nine ten eleven twelve " + texts[4]
    texts[5] = "two three four five six seven eight nine ten eleven twelve; three four five six seven eight nine ten eleven twelve"
    texts[6] = "a short one short-one short two"
    texts[7] = "É é ü ß é Ü ß x secret item"
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (5, None), (3, "X")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_brute_force(spark, tmp_path):
    df = documents(spark)
    got = op8_decontamination(spark, tables(spark, tmp_path, df, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute([tuple(r) for r in df.collect()], ITEMS)


@pytest.mark.parametrize("bits", [28, 16])
def test_a_benchmark_beyond_the_broadcast_gives_the_same(spark, monkeypatch, bits):
    """Also with a bitmap so small that it lets wrong windows pass."""
    monkeypatch.setattr(decontamination, "BITS", bits)
    texts = sentences(77, 400)
    df = documents(spark).unionByName(spark.createDataFrame([(1000 + i, texts[i] + " one two " + texts[i + 1]) for i in range(200)], "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS + [(100 + i, texts[2 * i]) for i in range(200)], "item_id long, text string")
    a, b = (sorted(map(str, benchmark_hits(df, items, broadcast_bytes=n).collect())) for n in (1 << 20, 100))
    assert a == b and sum("hit_items=[]" not in x for x in a) > 100


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    df = awkward(spark)
    got = op8_decontamination(spark, tables(spark, tmp_path, df, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()], ITEMS)
    assert op8_decontamination(spark, tables(spark, tmp_path, empty(spark), ITEMS)).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in benchmark_hits(df.withColumnRenamed("term", "n_hit"), none).select("n_hit_").toDF("n_hit").collect()} == {0}
