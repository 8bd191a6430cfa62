import random
import re

import pytest

from docloom.llm.tokencounts import Automaton, op10_token_counts, vocabulary
from tests.llm.helpers import awkward, empty, sentences, written


def greedy(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        pieces = inner if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_greedy_longest_match(seed):
    rnd = random.Random(seed)
    make = lambda n, most: frozenset("".join(rnd.choice("abc") for _ in range(rnd.randint(1, most))) for _ in range(n))
    first, inner = make(8, 4), make(10, 5)
    automaton = Automaton(first, inner)
    for _ in range(300):
        word = "".join(rnd.choice("abcd" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randint(1, 14)))
        assert automaton.count(word) == greedy(word, first, inner), (word, first, inner)


def brute(rows):
    first, inner = vocabulary()
    out = []
    for d, t in rows:
        counts = [greedy(w, first, inner) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") if len(w) < 200]
        out.append((d, len(counts), sum(c or 1 for c in counts), counts.count(0)))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(sentences(4, 80))] + [(100, "naïve 字符 𝄞x Straße"), (None, "one"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, op10_token_counts(spark, written(df, tmp_path)).collect()), key=str) == brute(rows)


def test_awkward_rows_and_empty(spark, tmp_path):
    df = awkward(spark)
    got = op10_token_counts(spark, written(df, tmp_path)).collect()
    assert len(got) == df.count() and {r["n_tokens"] for r in got if r["doc_id"] == 8} == {0}
    assert op10_token_counts(spark, written(empty(spark), tmp_path)).collect() == []
