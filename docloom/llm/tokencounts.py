"""Token counts by a linear longest-match automaton (Song et al., EMNLP 2021), without building the pieces.

The vocabulary is the word-piece view of a public sentence-piece vocabulary: pieces that begin with the word mark start
a word, the others continue one. A trie holds both. When a match can go no further, a node's failure link leads to the
node of what is left after the pieces that greedy matching surely takes there, and the precomputed number of these
popped pieces is added: each character is looked at once, plus one failure step for each popped group. A word that
greedy matching cannot spell is one unknown token, as in word-piece models.

Words are runs between white space, whole and uncapped. Null and empty texts have no words and no tokens. Repeated rows
each get the same result; other columns pass through; an empty table gives an empty table. There is no shuffle. Each
Python worker keeps the counts of at most CACHE words, a speed-up that changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import fresh, read, sliced, worker_cache

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
CACHE = 500_000


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> tuple[frozenset[str], frozenset[str]]:
    """The pieces that start a word (without the mark) and those that continue one."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    first = frozenset(p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:])
    return first, frozenset(p for p in pieces if MARK not in p)


class Automaton:
    """Nodes are numbers; node 0 starts a word and node 1 continues one.

    `go[v]` maps a character to the next node, `fail[v]` is the node after the popped pieces (-1: none), and `pops[v]` says how
    many pieces are popped on the way.
    """

    def __init__(self, first: frozenset[str], inner: frozenset[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, words in ((0, first), (1, inner)):
            for word in words:
                v = root
                for c in word:
                    v2 = self.go[v].get(c)
                    if v2 is None:
                        v2 = self.go[v][c] = len(self.go)
                        self.go.append({})
                        ends.append(False)
                    v = v2
                ends[v] = True
        self.fail, self.pops = [-1] * len(self.go), [0] * len(self.go)
        layer = [0, 1]
        while layer:
            following = []
            for u in layer:
                for c, v in self.go[u].items():
                    following.append(v)
                    if ends[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z != -1 and c not in self.go[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.pops[v] = self.go[z][c], n
            layer = following

    def count(self, word: str) -> int:
        """How many pieces greedy longest match gives the word; 0 if it cannot spell it."""
        go, fail, pops = self.go, self.fail, self.pops
        v = n = 0
        for c in word:
            while (step := go[v].get(c)) is None:
                n += pops[v]
                v = fail[v]
                if v == -1:
                    return 0
            v = step
        while v != 1:
            n += pops[v]
            v = fail[v]
            if v == -1:
                return 0
        return n


class WordCounts(dict):
    """Counts of the words (as UTF-8) that were asked for, emptied when there are too many."""

    def __init__(self, name: str):
        self.count = Automaton(*vocabulary(name)).count

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.count(word.decode())
        return n


def token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns of df and n_words, n_tokens (with unknown words as one each) and n_unknown, all long."""
    names = fresh(df, "n_words", "n_tokens", "n_unknown")
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = worker_cache(("token counts", vocabulary), lambda: WordCounts(vocabulary))
        for batch in sliced(batches):
            rows = []
            for body in batch.column(columns.index(text)).to_pylist():
                counts = [of[w] for w in body.encode().split()] if body else []  # bytes.split knows ASCII white space only
                unknown = counts.count(0)
                rows.append((len(counts), sum(counts) + unknown, unknown))
            more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` long" for n in names)])
    return df.mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).drop("text")
