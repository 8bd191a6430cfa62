"""Language identification by unigrams over a fixed public vocabulary, with all segmentations summed.

A word (a run of letters, lower-cased, after a word mark) has the probability, in a language, of all ways to cut it
into pieces of the vocabulary: the forward algorithm adds them up. Characters that no piece covers are pieces of their
own, with a floor probability. A text's score for a language is the sum over its words of the logarithms, plus that of
the language's share; the prediction is the language with the highest, `score` its posterior.

Learning: the words of all training texts are counted by language (one pass, combined before the shuffle); starting
from even probabilities, EM rounds distribute each word's count over its pieces by the forward-backward algorithm and
add the expected counts by piece. Every language of the table is learned; driver and tasks hold one number for each piece of the vocabulary
and language (some 0.2 MB a language), and more languages than `most_languages` are an error, where it is given: none is left out.

A text's `lang_fit` tells how well it fits the predicted language: the mean logarithm a letter, less that of the language's
learning texts (0: as well; below -MARGIN: in none of the learned languages, such as typing at random or another script). Where the mean
is below -MARGIN, the median over the letters counts instead if it is higher, so that a key or a code among ordinary words does not speak for
the text. Texts of less than LEAST letters aren't judged.

A text that is null or has no letter is `und`, with score 0; so is every text if nothing was learned. Null lang is
never learned from. Ties go to the first name. Repeated rows each get the same result; long texts are read whole; an
empty table gives an empty table; other columns pass through, and the results' names give way to theirs. Prediction is
one pass without a shuffle; the model is broadcast, its size bounded by the vocabulary and the number of languages.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import durable, fresh, q, read, sliced, worker_cache

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
ROUNDS = 2
MARGIN, LEAST = 2.5, 60  # nats a letter; letters
CACHE = 400_000
SHORT = 30
RISE = 50.0
SMOOTH = 0.1  # added to every expected count
FOLDS, HELD_OUT = 5, 0


@lru_cache(maxsize=2)
def pieces(name: str = VOCABULARY) -> tuple[dict[str, int], int]:
    """The vocabulary's pieces of letters, lower-cased, with or without the word mark, by number; the longest one's length."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = set()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        body = p.removeprefix(MARK)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (LETTERS.fullmatch(body) or p == MARK):
            found.add(p[: len(p) - len(body)] + body.lower())
    return {p: i for i, p in enumerate(sorted(found))}, max(map(len, found))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    words = LETTERS.findall(text.lower())
    return words if "".join(words).isalpha() else [w for w in words if any(map(str.isalpha, w))]


@dataclass
class Trie:
    """The pieces' characters as a table of steps: step[node, dense[c]] is the next node, 0 if there is none; 1 is the root.

    Only characters of pieces of two or more have a column; `alone[c]` is the piece of a character by itself.
    """

    dense: np.ndarray
    step: np.ndarray
    piece: np.ndarray
    alone: np.ndarray


@lru_cache(maxsize=2)
def trie(name: str = VOCABULARY) -> Trie:
    number, _ = pieces(name)
    longer = [p for p in number if len(p) > 1]
    column = {c: i for i, c in enumerate(sorted(set("".join(longer))), 1)}
    nodes: dict[tuple[int, int], int] = {}
    ends = {}
    for p in longer:
        node = 1
        for c in p:
            node = nodes.setdefault((node, column[c]), len(nodes) + 2)
        ends[node] = number[p]
    own = Trie(np.zeros(0x110000, dtype=np.int16), np.zeros((len(nodes) + 2, len(column) + 1), dtype=np.int32), np.full(len(nodes) + 2, -1, dtype=np.int32), np.full(0x110000, len(number), dtype=np.int32))
    own.dense[[ord(c) for c in column]] = list(column.values())
    for (node, c), following in nodes.items():
        own.step[node, c] = following
    own.piece[list(ends)] = list(ends.values())
    for p, i in number.items():
        if len(p) == 1:
            own.alone[ord(p)] = i
    return own


class Lattices:
    """All ways to cut some words (after a mark) into pieces, as arrays of arcs: word, begin, end, piece."""

    def __init__(self, words: list[str], name: str):
        own = trie(name)
        self.lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        codes = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), dtype=np.uint32)
        word = np.repeat(np.arange(len(words)), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        begin = np.arange(len(codes)) - first[word]
        found = [(word, begin, begin + 1, own.alone[codes])]
        dense, at, node = own.dense[codes], np.arange(len(codes)), np.ones(len(codes), dtype=np.int32)
        left = self.lengths[word] - begin  # characters from here to the word's end
        for depth in range(len(codes)):
            go = left[at] > depth
            at, node = at[go], node[go]
            node = own.step[node, dense[at + depth]]
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            ends = own.piece[node] >= 0
            found.append((word[at[ends]], begin[at[ends]], begin[at[ends]] + depth + 1, own.piece[node[ends]]))
        self.word, self.begin, self.end, self.piece = (np.concatenate(x) for x in zip(*found))

    def sweep(self, values: np.ndarray, weights: np.ndarray, forward: bool) -> np.ndarray:
        """Fills values[word, place] with the sums over arcs that end (or, backward, begin) there, one place at a time."""
        to, from_ = (self.end, self.begin) if forward else (self.begin, self.end)
        order = np.lexsort((self.word, to))
        cuts = np.searchsorted(to[order], np.arange(values.shape[1] + 1))
        places = range(1, values.shape[1]) if forward else range(values.shape[1] - 2, -1, -1)
        for place in places:
            own = order[cuts[place] : cuts[place + 1]]
            if len(own):
                words = self.word[own]
                heads = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                values[words[heads], place] = np.add.reduceat(values[words, from_[own]] * weights[own], heads, axis=0)
        return values


@dataclass
class Model:
    """weights[piece, language]: probabilities; the last row is the floor for a character that is no piece.

    Sums over segmentations are held multiplied by RISE for each character, so that no word of up to SHORT letters
    comes near the ends of the number range; longer words are scaled place by place.
    """

    languages: list[str]
    priors: np.ndarray
    weights: np.ndarray
    vocabulary: str = VOCABULARY
    typical: np.ndarray | None = None  # of the learning texts, the mean logarithm a letter by language

    def raised(self, own: Lattices, language: np.ndarray | slice) -> np.ndarray:
        w = self.weights[own.piece] if isinstance(language, slice) else self.weights[own.piece, language[own.word]]
        rise = RISE ** (own.end - own.begin)
        return w * (rise[:, None] if w.ndim == 2 else rise)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        step = max(16, min(4096, 4_000_000 // (SHORT * max(1, len(self.languages)))))
        for at in range(0, len(short), step):
            index = short[at : at + step]
            own = Lattices([words[i] for i in index], self.vocabulary)
            alpha = np.zeros((len(index), SHORT + 2, len(self.languages)))
            alpha[:, 0] = 1.0
            own.sweep(alpha, self.raised(own, slice(None)), True)
            out[index] = np.log(alpha[np.arange(len(index)), own.lengths]) - (own.lengths * math.log(RISE))[:, None]
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = [self.scaled(word, k)[1][-1] for k in range(len(self.languages))]
        return out

    def of_own_language(self, words: list[str], languages: np.ndarray) -> np.ndarray:
        """Of each word in the language of its place."""
        out = np.empty(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for at in range(0, len(short), 4096):
            index = short[at : at + 4096]
            own = Lattices([words[i] for i in index], self.vocabulary)
            alpha = np.zeros((len(index), SHORT + 2))
            alpha[:, 0] = 1.0
            own.sweep(alpha, self.raised(own, languages[index]), True)
            out[index] = np.log(alpha[np.arange(len(index)), own.lengths]) - own.lengths * math.log(RISE)
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = self.scaled(word, int(languages[i]))[1][-1]
        return out

    def scaled(self, word: str, language: int) -> tuple[list[list[tuple[int, int]]], list[float]]:
        """A long word's arcs by end, and the logarithm of the sum over all ways to each place."""
        own, n = Lattices([word], self.vocabulary), len(word) + 1
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for b, e, p in zip(own.begin.tolist(), own.end.tolist(), own.piece.tolist()):
            arcs[e].append((b, p))
        logs = [0.0]
        for e in range(1, n + 1):
            top = max(logs[b] for b, _ in arcs[e])
            logs.append(top + math.log(sum(self.weights[p, language] * math.exp(logs[b] - top) for b, p in arcs[e])))
        return arcs, logs

    def add_expected(self, words: list[str], languages: list[int], counts: list[int], sums: np.ndarray) -> None:
        """Adds to sums[piece, language] how often each piece is expected, over all segmentations of all words."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        for at in range(0, len(short), 4096):
            index = short[at : at + 4096]
            own = Lattices([words[i] for i in index], self.vocabulary)
            language, n = np.array([languages[i] for i in index]), np.array([counts[i] for i in index], dtype=float)
            weights, rows = self.raised(own, language), np.arange(len(index))
            alpha, beta = np.zeros((2, len(index), SHORT + 2))
            alpha[:, 0] = 1.0
            beta[rows, own.lengths] = 1.0
            own.sweep(alpha, weights, True)
            own.sweep(beta, weights, False)
            share = alpha[own.word, own.begin] * weights * beta[own.word, own.end] / alpha[rows, own.lengths][own.word]
            np.add.at(sums, (own.piece, language[own.word]), share * n[own.word])
        for i, word in enumerate(words):
            if len(word) > SHORT:
                self._add_long(word, languages[i], counts[i], sums)

    def _add_long(self, word: str, language: int, count: int, sums: np.ndarray) -> None:
        arcs, alpha = self.scaled(word, language)
        beta = [-math.inf] * len(alpha)
        beta[-1] = 0.0
        for e in range(len(alpha) - 1, 0, -1):
            for b, p in arcs[e]:
                through = math.log(self.weights[p, language]) + beta[e]
                sums[p, language] += count * math.exp(min(0.0, alpha[b] + through - alpha[-1]))
                high, low = max(beta[b], through), min(beta[b], through)
                beta[b] = high + math.log1p(math.exp(low - high))


class WordScores:
    """Sums of the words' logarithms; keeps those of recent words, up to a number that bounds the memory."""

    def __init__(self, model: Model):
        self.model, self.most = model, max(10_000, min(CACHE, 20_000_000 // max(1, len(model.languages))))
        self.row: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)))

    def sums(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.row))
        if self.row and len(self.row) + len(new) > self.most:
            self.row, self.table = {}, self.table[:0]
            new = list(dict.fromkeys(w for words in texts for w in words))
        for w in new:
            self.row[w] = len(self.row)
        if new:
            if len(self.row) > len(self.table):
                grown = np.empty((max(len(self.row), 2 * len(self.table)), self.table.shape[1]))
                grown[: len(self.table)] = self.table
                self.table = grown
            self.table[len(self.row) - len(new) : len(self.row)] = self.model.log_probabilities(new)
        return [self.table[[self.row[w] for w in words]].sum(axis=0) for words in texts]

    def fit(self, words: list[str], language: int, mean: float) -> float:
        """How well the text of the last `sums` fits the language: a logarithm a letter, less the language's own."""
        mean -= float(self.model.typical[language])
        if mean >= -MARGIN:
            return mean
        letters = np.array([len(w) for w in words])
        own = self.table[[self.row[w] for w in words], language] / letters - self.model.typical[language]
        order = np.argsort(own, kind="stable")
        return max(mean, float(own[order][np.searchsorted(np.cumsum(letters[order]), letters.sum() / 2)]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    counts: Counter = Counter()
    for batch in sliced(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(words_of(text)).items():
                counts[lang, word] += n
            if len(counts) > CACHE:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", rounds: int = ROUNDS, most_languages: int | None = None, vocabulary: str = VOCABULARY) -> Model:
    """From all rows with a language; the caller leaves out those that are not for learning."""
    spark = docs.sparkSession
    rows = docs.select(q(lang).cast("string").alias("lang"), q(text).alias("text")).filter("lang IS NOT NULL")
    shares = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    if most_languages is not None and len(shares) > most_languages:
        raise ValueError(f"{len(shares)} languages, more than {most_languages}")
    number, _ = pieces(vocabulary)
    languages = [k for k, _ in shares]
    model = Model(languages, np.log(np.array([n for _, n in shares], dtype=float) / max(1, sum(n for _, n in shares))), np.full((len(number) + 1, len(languages)), 1 / (len(number) + 1)), vocabulary)
    if not languages:
        return model
    index = {k: i for i, k in enumerate(languages)}
    words = durable(rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = shared.value, np.zeros((len(number) + 1, len(index)))
            for batch in batches:
                langs, texts, counts = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
                own.add_expected(texts, [index[k] for k in langs], counts, sums)
            at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(sums[at], pa.float64())], names=["piece", "lang", "n"])

        got = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full((len(number) + 1, len(languages)), SMOOTH)
        sums[got["piece"], got["lang"]] += np.round(got["n"], 6)
        model = Model(languages, model.priors, sums / sums.sum(axis=0), vocabulary)
    final = spark.sparkContext.broadcast(model)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = final.value, np.zeros((2, len(index)))
        for batch in batches:
            langs, texts, counts = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            of = np.array([index[k] for k in langs], dtype=np.int64)
            n = np.array(counts, dtype=float)
            if len(of):
                np.add.at(sums[0], of, n * own.of_own_language(texts, of))
                np.add.at(sums[1], of, n * np.array([len(w) for w in texts]))
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["lang", "log", "letters"])

    got = words.mapInArrow(logs, "lang int, log double, letters double").groupBy("lang").agg(F.sum("log").alias("log"), F.sum("letters").alias("letters")).collect()
    model.typical = np.zeros(len(languages))
    for r in got:
        model.typical[r["lang"]] = round(r["log"] / r["letters"], 6)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of docs and lang_pred, score, lang_fit (null if not judged) and lang_letters."""
    columns, names = docs.columns, fresh(docs, "lang_pred", "score", "lang_fit", "lang_letters")
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = worker_cache(key, lambda: WordScores(own))
        for batch in sliced(batches):
            pred, score, fit, letters = [], [], [], []
            bodies = batch.column(columns.index(text)).to_pylist()
            for at in range(0, len(bodies), 100):
                texts = [words_of(x) for x in bodies[at : at + 100]]
                for words, logs in zip(texts, scores.sums(texts)):
                    letters.append(sum(map(len, words)))
                    if not words or not own.languages:
                        pred.append("und"), score.append(0.0), fit.append(None)
                        continue
                    post = logs + own.priors
                    best = int(np.argmax(post))
                    pred.append(own.languages[best]), score.append(float(1 / np.exp(post - post[best]).sum()))
                    fit.append(scores.fit(words, best, float(logs[best] / letters[-1])) if letters[-1] >= LEAST else None)
            more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64()), pa.array(letters, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` double, `{names[3]}` long"])
    return docs.mapInArrow(run, schema)


def in_a_language(docs: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows whose text has a letter and isn't judged to be in none of the learned languages.

    If nothing was learned, no text is judged.
    """
    found = identify(docs, model, text)
    fit, letters = found.columns[-2:]
    return found.filter((q(letters) > 0) & (F.coalesce(q(fit), F.lit(0.0)) >= -margin)).select(*[q(c) for c in docs.columns])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; an id that is null has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(fold(F.col("doc_id")) != HELD_OUT))
    held_out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return identify(held_out, model).select("doc_id", "held_out", "lang_pred", "score")
