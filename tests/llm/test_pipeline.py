import corpus_pipeline as C
from docloom.llm import neardup
from tests.llm.helpers import awkward, empty, sentences, written
from tests.llm.test_packing import reference_ids


def tables(spark, docs, path, items=(("q1", "zz one two three four five six seven eight nine ten zz"),)):
    spark.createDataFrame(list(items), "item_id string, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return written(docs, path)


def corpus(spark):
    texts = sentences(21, 120, 60)
    texts = [t if len(t.split()) > 12 else t + " " + " ".join(sentences(500 + i, 1, 30)) + f" tail number {i} of this one" for i, t in enumerate(texts)]
    base = " ".join(sentences(22, 4, 60))
    near = [base + f" x{i}" for i in range(5)]
    leak = "before it ZZ one, two three four five six seven eight nine ten zz and after"
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t)) for i, t in enumerate([*texts, *near, leak, "12345 !!", ""])]
    return spark.createDataFrame([*rows, (900, None, "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long"), len(texts), len(near)


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs, clean, near = corpus(spark)
    path = tables(spark, docs, tmp_path)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    a = C.language_id(spark, docs, path)
    assert ids(a) == list(range(clean + near + 1))
    b = C.line_dedup(spark, a, path)
    c = C.near_dedup(spark, b, path)
    assert ids(c) == [*range(clean + 1), clean + near]
    d = C.decontaminate(spark, c, path)
    assert ids(d) == list(range(clean + 1))
    assert all(x.columns == docs.columns for x in (a, b, c, d))
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    pieces = {}
    for r in C.run(spark, path).collect():
        pieces.setdefault(r["doc_id"], {})[r["start"]] = bytes(r["ids"])
    for i, own in zip(texts, reference_ids(list(texts.values()))):
        assert b"".join(pieces[i][k] for k in sorted(pieces[i])) == b"".join(x.to_bytes(2, "little") for x in own)
    assert sorted(pieces) == sorted(texts)


def test_awkward_and_empty(spark, tmp_path):
    for name, make in (("a", awkward), ("e", empty)):
        docs = make(spark).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars", "shard", "part")
        got = C.run(spark, tables(spark, docs, tmp_path / name)).collect()
        assert bool(got) == (name == "a")


def links(a, b, width, limit):
    def own(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    a, b = own(a), own(b)
    return bool(a and b) and 100 * len(a & b) >= limit * len(a | b)


def components(rows, width, limit):
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and label[i] != label[j] and links(rows[i][1], rows[j][1], width, limit):
                label = [label[j] if x == label[i] else x for x in label]
    return [None if rows[i][0] is None else min(rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None) for i in range(len(rows))]


def mixed():
    import random

    rnd = random.Random(5)
    rows = list(enumerate(sentences(31, 40, 30)))
    for g in range(4):
        words = sentences(40 + g, 3, 60)[0].split() * 1 + sentences(60 + g, 3, 60)[1].split()
        for _ in range(12):
            own = list(words)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = f"w{rnd.randint(0, 50)}"
            rows.append((len(rows), " ".join(own[: rnd.randint(len(own) * 8 // 10, len(own))])))
    return [*rows, (200, "one"), (201, "ONE"), (202, "one two"), (203, None), (204, ""), (205, " \n"), (None, rows[50][1]), (3, rows[60][1]), (206, rows[60][1].upper())]


def test_near_duplicates_are_the_exact_components(spark):
    rows = mixed()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, limit in ((3, 85), (5, 80)):
        got = sorted(map(tuple, neardup.near_duplicates(df, width=width, limit=limit).select("doc_id", "component_id", "kept").collect()), key=str)
        want = sorted(((d, c, None if d is None else d == c) for (d, _), c in zip(rows, components(rows, width, limit))), key=str)
        assert got == want


def test_links_in_large_buckets_are_all_found(spark, monkeypatch):
    """Pairs of a template whose documents aren't linked to each other nor to a pivot."""
    monkeypatch.setattr(neardup, "CHUNK", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    template = " ".join(f"t{i}" for i in range(170))
    tail = lambda i: [f"p{i // 2}x{k}" for k in range(8)] + [f"d{i}x{k}" for k in range(13)]
    rows = [(i, f"{template} {' '.join(tail(i))}") for i in range(120)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, limit=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(zip(range(120), components(rows, 3, 85))) == {i: i - i % 2 for i in range(120)}


def test_a_group_that_nothing_joins_meets_its_buckets_three_times(spark, monkeypatch):
    """The pivots, one deal of chunks, and all pairs; a member has one row a bucket each time."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    met, opened = [], neardup._open

    def counted(buckets, labels):
        members = opened(buckets, labels)
        met.append((members.count(), members.select("band", "key", "node").distinct().count(), buckets.count()))
        return members

    monkeypatch.setattr(neardup, "_open", counted)
    template = " ".join(f"t{i}" for i in range(170))
    rows = [(i, f"{template} {' '.join(f'd{i}x{k}' for k in range(21))}") for i in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, limit=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in range(60)}
    assert len(met) == 3 and all(made == members <= all_ for made, members, all_ in met) and met[0][0] > 60


def test_near_duplicates_awkward(spark, tmp_path):
    df = awkward(spark)
    got = neardup.op6_near_dedup(spark, written(df, tmp_path)).collect()
    assert len(got) == df.count() and {r["component_id"] for r in got if r["doc_id"] in (1, 6)} == {1}
    assert neardup.op6_near_dedup(spark, written(empty(spark), tmp_path)).collect() == []


def test_merge_finds_components_of_chains_and_stars(spark):
    import random

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300)]
    random.Random(1).shuffle(edges)
    nodes = sorted({x for e in edges for x in e} | {999})
    labels = neardup.merge(spark.createDataFrame([(n, n) for n in nodes], "node long, comp long"), spark.createDataFrame(edges, "x long, y long"))
    by = {}
    for r in labels.collect():
        by.setdefault(r["comp"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == sorted([list(range(41)), list(range(100, 160)), [300, 301], [999]])


def test_signature_estimates_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.5, 0.85):
        own = []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            both = int(share * 2 / (1 + share) * 300)
            own.append((neardup.signature(x[:300]) == neardup.signature(np.concatenate([x[:both], x[300 : 600 - both]]))).mean())
        assert abs(np.mean(own) - share) < 0.03
