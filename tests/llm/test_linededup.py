import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import linededup as L
from tests.llm.helpers import awkward, empty, sentences, written


def brute(rows):
    """rows: (id, text). Compares all removable chunks as bytes."""
    first, out = {}, []
    for i, t in rows:
        for _, body, *_ in L.removable(t) if i is not None else ():
            first[body] = min(first.get(body, i), i)
    for i, t in rows:
        lines, gone, seen = (t or "").encode().split(b"\n"), set(), set()
        for _, body, s, e in L.removable(t):
            if body in seen or (i is not None and first[body] < i):
                gone.update(range(s, e))
            seen.add(body)
        text = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
        out.append((i, 0 if t is None else len(lines), len(gone), None if t is None else text))
    return sorted(out, key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    passages = [sentences(10 + k, rnd.randint(3, 12), 12) for k in range(6)]
    long_line = " ".join(sentences(50, 8, 30))
    rows = []
    for i in range(150):
        lines = sentences(1000 + i, rnd.randint(1, 10), 12)
        for p in passages:
            if rnd.random() < 0.15:
                lines[rnd.randint(0, len(lines)) : 0] = p
        if rnd.random() < 0.3:
            lines.insert(rnd.randint(0, len(lines)), long_line)
        rows.append((i, "\n".join(lines * (2 if i % 17 == 0 else 1))))
    rows += [(150, rows[3][1]), (151, rows[3][1]), (3, rows[3][1]), (4, "x"), (None, rows[5][1]), (152, None), (153, ""), (154, "\n\n\n")]
    return rows


@pytest.mark.parametrize("most", [L.BROADCAST, 0])
def test_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(L, "BROADCAST", most)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert sorted(map(tuple, L.op3_line_dedup(spark, written(df, tmp_path)).collect()), key=str) == brute(corpus())


def test_long_passages_go_and_one_stays(spark):
    rows = corpus()
    passage = " ".join(sentences(50, 8, 30))
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(passage in (r["text"] or "") for r in got if r["doc_id"] is not None) == 1


def test_boundaries_shift_with_the_lines():
    lines = sentences(7, 200, 12)
    cut = lambda ls: {"\n".join(ls[s:e]) for s, e, _ in L.chunks("\n".join(ls).encode())}
    assert len(cut(lines) - cut(["one more line", *lines])) <= 2


def test_chunks_cover_everything():
    for t in [b"", b"a", b"\n", b"a\nb", b"w " * 60, b"\n".join(b"line %d" % (i % 7) for i in range(500))]:
        own = L.chunks(t)
        assert [s for s, _, _ in own] == [0, *(e for _, e, _ in own[:-1])] and own[-1][1] == t.count(b"\n") + 1


@pytest.mark.parametrize("n, words", [(1, 60), (2, 30), (3, 20), (4, 15), (4, 45), (6, 12), (10, 12), (20, 3), (60, 1)])
def test_passages_of_any_lines_go_whole(spark, n, words):
    passage = [" ".join(f"p{i}w{k}" for k in range(words)) for i in range(n)]
    rows = []
    for i in range(30):
        own = [f"{line} own{i}" for line in sentences(2000 + i, 8, 12)]
        own[i % 9 : 0] = passage
        rows.append((i, "\n".join(own)))
    for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        left = r["text"].split("\n")
        assert sum(x in left for x in passage) == (0 if r["doc_id"] else n) and len(left) == 8 + (0 if r["doc_id"] else n)


def test_chunks_are_the_repeated_runs():
    rnd = random.Random(3)
    for _ in range(300):
        words = [rnd.choice([0, 0, 1, 2, 3, 5, 8, 20, 49, 50]) for _ in range(rnd.randint(1, 14))]
        own = L._runs(words)
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                if (e - s > 1 and sum(words[s:e]) >= L.SHORT_WORDS) or (e - s == 1 and words[s] >= L.LONG_WORDS):
                    covered = {i for a, b in own if s <= a and b <= e for i in range(a, b)}
                    assert covered >= {i for i in range(s, e) if words[i]}


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    got = L.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"] and got.count() == df.count()
    assert L.op3_line_dedup(spark, written(empty(spark), tmp_path)).collect() == []


def test_rows_without_an_id_meet_in_no_task(spark):
    """A third of all rows without a doc_id: they lose their inner repeats where they are read."""
    line = " ".join(sentences(90, 8, 30)) + " end" * L.LONG_WORDS
    rows = [(i if i % 3 else None, f"{line}\n{i}\n{line}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = L.dedup_lines(docs).withColumn("at", F.spark_partition_id()).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got), key=str) == brute(rows)
    places = Counter(r["at"] for r in got if r["doc_id"] is None)
    assert sum(places.values()) == 200 and max(places.values()) < 100


def test_rows_of_one_id_hold_each_lost_chunk_once(spark):
    passage = "\n".join(sentences(91, 6, 12))
    rows = [(1, passage)] + [(2, f"{passage}\n{i}") for i in range(50)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_sql_on_awkward_texts():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rnd = random.Random(5)
    lines = [" ".join(f"w{rnd.randint(0, 1)}" for _ in range(n)) for n in (0, 0, 1, 1, 3, 4, 8, 9, 49, 50, 55)] + ["\x1c a\x0b b", "\t"]
    rows = corpus() + [(rnd.choice([None, *range(1000, 1100)]), "\n".join(rnd.choices(lines, k=rnd.randint(1, 12)))) for _ in range(300)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(L.SQL).fetchall(), key=str) == brute(rows)
