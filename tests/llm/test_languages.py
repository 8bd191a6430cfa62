import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import languages as L
from tests.llm.helpers import awkward, empty, written


def segmentations(word, number):
    s = L.MARK + word
    for cuts in itertools.product((0, 1), repeat=len(s) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(s)]
        own = [s[a:b] for a, b in zip(at, at[1:])]
        if all(p in number or len(p) == 1 for p in own):
            yield [number.get(p, len(number)) for p in own]


def model(k=3):
    number, _ = L.pieces()
    w = np.random.default_rng(1).random((len(number) + 1, k)) ** 8 + 1e-9
    return L.Model([f"l{i}" for i in range(k)], np.zeros(k), w / w.sum(axis=0))


WORDS = ["a", "the", "hello", "naïve", "ſtraße", "字a", "informatio"]


def test_forward_sums_all_segmentations():
    m, (number, _) = model(), L.pieces()
    got = m.log_probabilities(WORDS)
    for word, row in zip(WORDS, got):
        brute = sum(np.prod(m.weights[list(s)], axis=0) for s in segmentations(word, number))
        assert np.allclose(row, np.log(brute))


def test_expected_counts_are_the_posterior_means():
    m, (number, _) = model(), L.pieces()
    for word in WORDS:
        ways = list(segmentations(word, number))
        p = np.array([np.prod(m.weights[list(s), 1]) for s in ways])
        brute = np.zeros(len(m.weights))
        for s, x in zip(ways, p / p.sum()):
            np.add.at(brute, s, 5 * x)
        sums = np.zeros_like(m.weights)
        m.add_expected([word], [1], [5], sums)
        assert np.allclose(sums[:, 1], brute) and not sums[:, [0, 2]].any()


def test_long_words_agree_with_short(monkeypatch):
    m, words = model(), ["internationalisation", "zzzqqq", "été"]
    short, sums = m.log_probabilities(words), np.zeros_like(m.weights)
    m.add_expected(words, [0, 1, 2], [1, 2, 3], sums)
    monkeypatch.setattr(L, "SHORT", 2)
    again = np.zeros_like(sums)
    m.add_expected(words, [0, 1, 2], [1, 2, 3], again)
    assert np.allclose(short, m.log_probabilities(words)) and np.allclose(sums, again)
    assert np.isfinite(m.log_probabilities(["ab" * 3000])).all()


def test_cache_changes_nothing(monkeypatch):
    m, texts = model(), [["the", "a", "b"], ["c", "the"], ["x" * 40, "a"]]
    plain = [m.log_probabilities(t).sum(axis=0) for t in texts]
    scores = L.WordScores(m)
    scores.most = 2
    assert np.allclose(np.concatenate([scores.sums([t]) for t in texts]), plain)


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    got = L.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r["lang_pred"] == r["truth"] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.97


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_rows(spark, tmp_path, make):
    df = make(spark)
    got = L.op9_language_id(spark, written(df, tmp_path)).collect()
    assert len(got) == df.count()
    learned = {r["lang"] for r in df.collect() if r["lang"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    for r in got:
        body = next(x["text"] for x in df.collect() if x["doc_id"] == r["doc_id"])
        assert r["lang_pred"] in learned if body and any(map(str.isalpha, body)) else (r["lang_pred"], r["score"]) == ("und", 0.0)


def learned(spark):
    rows = [("the cat sat on the mat and the dog ran to the house by the river " * 3, "en"), ("der hund und die katze sind in dem haus an dem fluss und das ist gut " * 3, "de")]
    return L.learn(spark.createDataFrame(rows * 5, "text string, lang string"))


def test_texts_of_no_learned_language_are_told_apart(spark):
    texts = ["the dog sat by the house and the river", "die katze und der hund sind an dem fluss", "xqzv kkjw qpfg zxwv bnmq wrtz pfxq " * 4, "\u044d\u0442\u043e \u0440\u0443\u0441\u0441\u043a\u0438\u0439 \u0442\u0435\u043a\u0441\u0442 \u043e\u0447\u0435\u043d\u044c \u0434\u043b\u0438\u043d\u043d\u044b\u0439" * 4, "ok xq", "", None, "123 !!", "the dog sat by the river and the cat ran to the house by the mat qzxjvkwqpfgzxwvbnmqwrtzpfxq", "on the AKIARJTPEYDFQBCZHJ mat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in L.in_a_language(df, learned(spark)).collect()) == [0, 1, 4, 8, 9]
    nothing = L.learn(df.withColumn("lang", F.lit(None).cast("string")))
    assert sorted(r["doc_id"] for r in L.in_a_language(df, nothing).collect()) == [0, 1, 2, 3, 4, 8, 9]


def test_typical_is_the_mean_over_the_learning_texts(spark):
    m = learned(spark)
    for k, text in (("en", "the cat sat on the mat and the dog ran to the house by the river"), ("de", "der hund und die katze sind in dem haus an dem fluss und das ist gut")):
        i, words = m.languages.index(k), text.split()
        assert abs(m.typical[i] - m.log_probabilities(words)[:, i].sum() / sum(map(len, words))) < 1e-5


def test_every_language_is_learned(spark):
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(2))
    rows = [(i, f"{word(i)}q {word(i)}z {word(i)}x " * 4, f"l{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.learn(df)
    assert len(m.languages) == 300
    got = L.identify(df, m).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) > 290
    with pytest.raises(ValueError):
        L.learn(df, most_languages=256)
