import hashlib
import re
from collections import Counter

from docloom.llm.fingerprints import SIZE, op2_fingerprint
from tests.llm.helpers import awkward, empty, sentences, written

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(t):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t.translate(UPPER)) if w)


def jaccard(a, b):
    a, b = bag(a), bag(b)
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def following(rows):
    """(id, text, next text) by descending id, nulls last, then text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    return [(d, t, rows[(i + 1) % len(rows)][1]) for i, (d, t) in enumerate(rows)]


def check(spark, df, path):
    got = sorted(map(tuple, op2_fingerprint(spark, written(df, path, 5)).select("doc_id", "n_chars", "edited_sha256").collect()), key=str)
    want = []
    for d, t, after in following([(r["doc_id"], r["text"]) for r in df.collect()]):
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k] if k else t
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_order_and_edits(spark, tmp_path):
    rows = [(i * 7 % 301, t) for i, t in enumerate(sentences(8, 200, 30))]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)


def test_awkward_rows(spark, tmp_path):
    check(spark, awkward(spark), tmp_path)
    assert op2_fingerprint(spark, written(empty(spark), tmp_path)).collect() == []


def test_likeness_is_generalised_jaccard(spark, tmp_path):
    texts = sentences(9, 120, 80)
    texts = [t + " " + " ".join(texts[i - 1].split()[: i % 40]) for i, t in enumerate(texts)]
    rows = [*enumerate(texts), (500, texts[3]), (501, " "), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in op2_fingerprint(spark, written(df, tmp_path)).collect()}
    assert got[500]["fingerprint"] == got[3]["fingerprint"] and got[502]["near_next"] == 1.0 and got[501]["near_next"] == 0.0
    errors, edits = [], []
    for d, t, after in following(rows):
        errors.append(got[d]["near_next"] - jaccard(t, after))
        k = len(t) // 3
        edits.append(got[d]["near_edited"] - jaccard(t, t[: len(t) - k] + after[:k]))
    for e in (errors, edits):
        assert abs(sum(e) / len(e)) < 0.03 and sum(x * x for x in e) / len(e) < 1.3 * 0.25 / SIZE
