"""Mixture-controlled packing: deficit round-robin over the queues of the sources, in closed form.

Every document is its tokens and an end token. The documents of a source are its queue, in the order of the stored
rows. A queue is served in quanta of `quantum` tokens (its last one may be shorter), so a document is cut at a few places only, however
small its source's share. Targets are shares of the tokens: those in `proportions`, the other sources sharing what these leave in
proportion to their tokens; without `proportions` every source's target is its own share of the corpus, so all queues
end together. With `proportions` the queues end one by one; from there on the others go on in proportion to their targets, and
sources without a target come last. No token is left out or repeated.

Windows are filled one after the other: a queue that got less than its share of what has been given out keeps the
difference as a deficit for the next window, and one that got more owes it. Two queues need no pass over the windows for
that: of the first N quanta the left one gets floor(N * left / (left + right)), its deficit being the fraction that is cut
off. A balanced binary tree of such pairs serves any number of queues, and the formula can be turned round: the j-th
quantum of the left queue is number ceil((j + 1) * all / left) - 1 of both, that of the right one number
floor(j * all / right). So a quantum's place among all is known from its queue and number alone, in any partition and
without a step over the windows between: the deficits pass across windows and partitions, and no task needs
another's windows. After any number of tokens, at the end of any window too, each queue is within log2(queues) + 1 quanta of its target.

The stream of quanta is cut into sequences of 1024 tokens: all are full but the last of all.

Null text is empty (one end token); a null source is a queue like others; repeated rows are separate documents; a long
text is cut like others. An empty table gives an empty table. Other columns play no part.

Texts are tokenised once and aren't shuffled: the token table is written to the shared folder with each document's
place in its partition's part of the queue; totals by partition and source then give the places in the whole queues. The
driver and a broadcast hold a few numbers a source; a column with a value for each row is no mixture, and source=None
makes one queue of all.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import durable, q, read, sliced

SEQUENCE = 1024
QUANTUM = 512
END = 0
NO_SOURCE = "\0null"
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json; the ids are the same, at four times the speed


@lru_cache(maxsize=1)
def encoder(vocabulary: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256  # the vocabulary's one added token, an id of its own wherever it stands in a text


def token_ids(text: str | None) -> list[int]:
    """As tokenizers gives them with add_special_tokens=False."""
    if not text:
        return []
    encode, out = encoder().encode_ordinary, []
    for i, part in enumerate(text.split(SPECIAL)):
        out += [SPECIAL_ID] if i else []
        out += encode(part)
    return out


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, queued = TaskContext.get().partitionId(), {}
    end = np.array([END], dtype="<u2").tobytes()
    for piece in sliced(batches):
        ids, starts, counts, queues = [], [], [], piece.column("queue").to_pylist()
        for text, queue in zip(piece.column("text").to_pylist(), queues):
            own = np.array(token_ids(text), dtype="<u2").tobytes() + end
            n, start = len(own) // 2, queued.get(queue, 0)
            queued[queue] = start + n
            ids.append(own), starts.append(start), counts.append(n)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array([part] * len(ids), pa.int32()), pa.array(queues, pa.string()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "part", "queue", "start", "n", "ids"],
        )


class Mixture:
    """The order in which the items of some queues are served if all of them end together."""

    def __init__(self, totals: list[int]):
        self.totals = totals
        self.prefix = [0, *accumulate(totals)]
        self.total = self.prefix[-1]

    def served(self, n: int, queue: int) -> int:
        """Items that the queue has got of the first `n`."""
        lo, hi = 0, len(self.totals)
        while hi - lo > 1:
            mid, all_ = (lo + hi) // 2, self.prefix[hi] - self.prefix[lo]
            left = n * (self.prefix[mid] - self.prefix[lo]) // all_ if all_ else 0
            lo, hi, n = (lo, mid, left) if queue < mid else (mid, hi, n - left)
        return n

    def place(self, item: int, queue: int) -> int:
        """The number among all items of the queue's item: `served` turned round, from the leaf up."""
        path, lo, hi = [], 0, len(self.totals)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            path.append((lo, mid, hi, queue < mid))
            lo, hi = (lo, mid) if queue < mid else (mid, hi)
        for lo, mid, hi, left in reversed(path):
            all_ = self.prefix[hi] - self.prefix[lo]
            item = -((item + 1) * all_ // -(self.prefix[mid] - self.prefix[lo])) - 1 if left else item * all_ // (self.prefix[hi] - self.prefix[mid])
        return item


class Schedule:
    """Where the tokens of each queue go. `totals`: tokens by queue; `targets`: shares of some queues, by number."""

    def __init__(self, totals: list[int], targets: dict[int, Fraction] | None = None, quantum: int = 512):
        self.quantum, self.totals = quantum, totals
        quanta = [-(-n // quantum) for n in totals]
        named = sorted(targets or {})
        rest = [k for k in range(len(totals)) if k not in set(named)]
        self.node = {k: i for i, k in enumerate(named)} | {k: len(named) for k in rest}
        self.within, self.inner = {k: i for i, k in enumerate(rest)}, Mixture([quanta[k] for k in rest])
        left = [quanta[k] for k in named] + [self.inner.total]
        weight = [Fraction(targets[k]) for k in named]
        weight.append(max(Fraction(0), 1 - sum(weight)))
        self.phases: list[tuple[int, list[int], Mixture]] = []  # places before it, items of each node before it, its own
        before, got = 0, [0] * len(left)
        while any(left):
            active = {i: weight[i] for i, n in enumerate(left) if n and weight[i]} or {i: Fraction(n) for i, n in enumerate(left) if n}
            lasts = min(left[i] / w for i, w in active.items())
            take = [min(left[i], int(lasts * active[i])) if i in active else 0 for i in range(len(left))]
            self.phases.append((before, got, Mixture(take)))
            before, got, left = before + sum(take), [a + b for a, b in zip(got, take)], [a - b for a, b in zip(left, take)]
        # A last quantum that is short moves all after it: the places of these, and by how much in all.
        short = sorted((self.place(quanta[k] - 1, k), quanta[k] * quantum - n) for k, n in enumerate(totals) if n % quantum)
        self.short, self.less = [p for p, _ in short], [0, *accumulate(n for _, n in short)]

    def place(self, item: int, queue: int) -> int:
        """The number among all quanta of the queue's quantum."""
        node = self.node[queue]
        if queue in self.within:
            item = self.inner.place(item, self.within[queue])
        before, got, mixture = self.phases[bisect_right(self.phases, item, key=lambda p: p[1][node]) - 1]
        return before + mixture.place(item - got[node], node)

    def token(self, item: int, queue: int) -> int:
        """The place among all tokens at which the queue's quantum begins."""
        place = self.place(item, queue)
        return place * self.quantum - self.less[bisect_left(self.short, place)]

    def pieces(self, queue: int, at: int, n: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document with `n` tokens at place `at` of its queue."""
        start, held = 0, None
        while start < n:
            item, into = divmod(at + start, self.quantum)
            place, stop = self.token(item, queue) + into, min(n, (item + 1) * self.quantum - at)
            while start < stop:
                length = min(stop - start, sequence - place % sequence)
                if held and held[2] == place // sequence and held[3] + held[1] == place % sequence:
                    held = (held[0], held[1] + length, *held[2:])  # goes on where the piece before it ended
                else:
                    if held:
                        yield held
                    held = (start, length, place // sequence, place % sequence)
                start, place = start + length, place + length
        if held:
            yield held


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source") -> DataFrame:
    """doc_id, part, queue, start, n and ids (little-endian unsigned 16-bit), written to the shared folder."""
    name = F.coalesce(q(source).cast("string"), F.lit(NO_SOURCE)) if source in docs.columns else F.lit("")
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, part int, queue string, start long, n long, ids binary"
    return durable(docs.select(q(doc_id).alias("doc_id"), q(text).cast("string").alias("text"), name.alias("queue")).mapInArrow(_tokenise, schema))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str | None = "source", proportions: dict[str | None, float] | None = None, quantum: int = QUANTUM, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, source queue, start, length, ids (of the piece), doc_tokens, sequence_id, offset.

    proportions: target shares of the tokens by source (None: rows without one), above 0 and together at most 1.
    """
    shares = {NO_SOURCE if k is None else k: Fraction(v).limit_denominator(1_000_000) for k, v in (proportions or {}).items()}
    if any(v <= 0 for v in shares.values()) or sum(shares.values()) > 1:
        raise ValueError("proportions are above 0 and together at most 1")
    spark = docs.sparkSession
    tokens = token_table(docs, doc_id, text, source)
    parts = tokens.groupBy("part", "queue").agg(F.sum("n").alias("part_n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(parts.select("part", "queue", "part_n", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("offset")))
    totals = offsets.groupBy("queue").agg(F.sum("part_n").alias("n")).orderBy("queue").collect()  # one row a source
    number = {r["queue"]: i for i, r in enumerate(totals)}
    schedule = Schedule([r["n"] for r in totals], {number[k]: v for k, v in shares.items() if k in number}, quantum)
    shared = spark.sparkContext.broadcast((number, schedule))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, schedule = shared.value
        for piece in sliced(batches):
            rows, starts, lengths, ids, sequences, offsets_ = [], [], [], [], [], []
            columns = (piece.column(c).to_pylist() for c in ("queue", "place", "n", "ids"))
            for i, (queue, place, n, own) in enumerate(zip(*columns)):
                for start, length, seq, offset in schedule.pieces(number[queue], place, n, sequence):
                    rows.append(i), starts.append(start), lengths.append(length), sequences.append(seq), offsets_.append(offset)
                    ids.append(own[2 * start : 2 * (start + length)])
            take = pa.array(rows, pa.int32())
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(take), piece.column("queue").take(take), longs(starts), longs(lengths), pa.array(ids, pa.binary()), piece.column("n").take(take), longs(sequences), longs(offsets_)],
                names=["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    placed = tokens.join(offsets.select("part", "queue", "offset"), ["part", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("start") + F.col("offset")).alias("place"), "n", "ids")
    schema = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = [zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
        columns = {c: batch.column(c) for c in batch.schema.names if c != "ids"} | {"ids_crc32": pa.array(crc, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    schema = f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    digests = pieces.mapInArrow(_digest, schema)
    return digests.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
