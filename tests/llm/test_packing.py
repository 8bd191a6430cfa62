import math
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docloom.llm.packing import Mixture, Schedule, op5_packing, pack, token_ids
from tests.llm.helpers import awkward, empty, sentences, written


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def whole(rows, texts, sequence=1024):
    """Every token in one piece, every sequence gapless and full but the last of all."""
    ids, by_doc, by_seq = reference_ids(texts), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, own in enumerate(ids):
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for seq, pieces in by_seq.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == sequence or (seq == len(by_seq) - 1 and at <= sequence)


def test_ids_are_the_tokenizers_own():
    texts = ["", " ", "Hello  world\n\n  x", "é𝄞ü naïve 字符", "a" * 3000, "1234567 don't I'll <|endoftext|> x", "<|endoftext|>", "a <|endoftext|><|endoftext|>\n\nb", "<|endoftext", *sentences(3, 50)]
    assert [token_ids(t) + [0] for t in texts] == reference_ids(texts)


def test_whole_and_full(spark, tmp_path):
    texts = [*sentences(5, 300, 400), "", " ", "zz " * 20_000]
    rows = [(i, t if t else None, f"s{i * i % 7}" if i % 11 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole(op5_packing(spark, written(df, tmp_path, 5)).collect(), texts)


def given(rows, quantum, shares, window=32 * 1024):
    """Every queue stays within log2(queues) + 1 quanta of its share at the end of each window, while none has ended."""
    left, so_far = {}, dict.fromkeys(shares, 0)
    for r in rows:
        left[r["queue"]] = left.get(r["queue"], 0) + r["length"]
    bound = (math.log2(len(shares)) + 1) * quantum
    cuts = sorted((r["sequence_id"] * 1024 + r["offset"], r["queue"], r["length"]) for r in rows)
    at, checked = 0, 0
    for place, queue, length in cuts:
        if place >= at + window:
            if all(left[k] - so_far[k] > bound for k in shares):
                checked += 1
                assert all(abs(so_far[k] - place * shares[k]) <= bound + 1024 for k in shares)
            at += window
        so_far[queue] += length
    return checked


def test_windows_hold_the_mixture(spark):
    texts = sentences(6, 2000, 300)
    df = spark.createDataFrame([(i, t, "big" if i % 3 else f"s{i % 5}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    rows = pack(df, quantum=64).collect()
    totals = {}
    for r in rows:
        totals[r["queue"]] = totals.get(r["queue"], 0) + r["length"]
    assert given(rows, 64, {k: n / sum(totals.values()) for k, n in totals.items()}) > 5


def test_target_proportions(spark):
    texts = sentences(7, 1500, 300)
    df = spark.createDataFrame([(i, t, "abc"[i % 3] if i % 30 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    rows = pack(df, quantum=64, proportions={"a": 0.6, "b": 0.3}).collect()
    totals = {}
    for r in rows:
        totals[r["queue"]] = totals.get(r["queue"], 0) + r["length"]
    other = totals["c"] + totals["\0null"]
    assert given(rows, 64, {"a": 0.6, "b": 0.3, "c": 0.1 * totals["c"] / other, "\0null": 0.1 * totals["\0null"] / other}) > 3
    whole([dict(doc_id=r["doc_id"], start=r["start"], length=r["length"], doc_tokens=r["doc_tokens"], sequence_id=r["sequence_id"], offset=r["offset"], ids_crc32=zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes())) for r in rows], texts)
    with pytest.raises(ValueError):
        pack(df, proportions={"a": 0.9, "b": 0.3})


@pytest.mark.parametrize("totals", [[5], [1, 1000], [3, 0, 7, 900, 1], list(range(1, 40))])
def test_places_turn_the_schedule_round(totals):
    m = Mixture(totals)
    order = sorted((m.place(j, k), k) for k in range(len(totals)) for j in range(totals[k]))
    assert [p for p, _ in order] == list(range(m.total))
    got = [0] * len(totals)
    for n, k in order:
        assert got[k] == m.served(n, k)
        got[k] += 1
        assert m.served(n + 1, k) == got[k]


@pytest.mark.parametrize("targets", [None, {0: Fraction(1, 2)}, {1: Fraction(1, 4), 3: Fraction(3, 4)}, {0: Fraction(1, 10), 1: Fraction(1, 10), 2: Fraction(1, 10), 3: Fraction(1, 10)}])
def test_every_token_has_one_place(targets):
    totals = [1000, 17, 5000, 640, 1]
    s, seen = Schedule(totals, targets, 64), set()
    for k, n in enumerate(totals):
        for start, length, seq, offset in s.pieces(k, 0, n, 100):
            own = range(seq * 100 + offset, seq * 100 + offset + length)
            assert offset + length <= 100 and not seen.intersection(own)
            seen.update(own)
    assert seen == set(range(sum(totals)))


def test_small_sources_are_not_shredded_and_cost_no_walk():
    import time

    s, began = Schedule([10**14, 1000, 3 * 10**9]), time.perf_counter()
    assert len(list(s.pieces(1, 0, 1000, 1024))) <= 4 and len(list(s.pieces(0, 10**13 + 7, 1000, 1024))) <= 5
    assert time.perf_counter() - began < 0.05
    many = Schedule([2000] * 5000)
    assert max(len(list(many.pieces(k, 300, 1500, 1024))) for k in range(0, 5000, 500)) <= 8


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    got = op5_packing(spark, written(df, tmp_path)).collect()
    assert sum(r["length"] for r in got) == sum(map(len, reference_ids([r["text"] for r in df.collect()])))


def test_empty(spark, tmp_path):
    assert op5_packing(spark, written(empty(spark), tmp_path)).collect() == []
