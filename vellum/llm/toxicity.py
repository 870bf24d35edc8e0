"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, come from a bounded sample of labelled
texts. Each interpolates its bigrams with its own continuation counts and those
with backoff counts that both share: exact counts of every word over every text
of the corpus, a written table that grows with it, of which the models take the
words of their sample, the sum and the number of words. A word that a class has
not seen falls back on them, so rare expressions weigh little. A text's words are compared in
length-normalised form: the mean log ratio over the text, the largest of a word by
itself, and the largest mean over runs of :data:`RUN` words, as one passage makes a
long text toxic. A logistic fit turns the three into a probability.

Fitted on at most :data:`PER_CLASS` rows of each label, none held out; every row
is scored. Every bigram of the sample is kept. Of a long text the sample has a block of
whole words; a text of one long word is scored and not fitted on.

Defined results: a null or empty text has ratios of 0; without rows of both labels
every score is the share of label 1 (0.5 without rows); repeated rows each get
their row.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vellum.llm.hash_table import HashTable
from vellum.llm.labelled import labelled_sample, logistic, probability
from vellum.llm.rows import at_task_end, held_out, map_texts, picked
from vellum.sources.scratch import Scratch

#: Bound of the sample: rows of each label, and bytes of a text that is fitted on.
PER_CLASS, MOST_BYTES = 2500, 32_768
#: Discounts of counts of 0, 1, 2 and more, as in modified Kneser-Ney.
DISCOUNTS = np.array([0.0, 0.9, 1.5, 2.0])
#: Words of a run; score from which label 1 is predicted.
RUN, PREDICTED_FROM = 8, 0.5
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()
at_task_end(_hashes.clear)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of a text's words, A-Z lower-cased."""
    found = text.lower().split()
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def _pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (before * _PAIR) ^ (words + (before >> np.uint64(17)))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of (word before, word), for all words but the first."""
    return _pairs(words[:-1], words[1:])


def discount(counts: np.ndarray) -> np.ndarray:
    return DISCOUNTS[np.minimum(counts, 3).astype(np.int64)]


class SharedCounts(NamedTuple):
    """Corpus counts of a sample's words by their sorted hashes, the sum over all words of the corpus, and how many words it has."""

    keys: np.ndarray
    n: np.ndarray
    total: int
    distinct: int

    def chance(self, words: np.ndarray) -> np.ndarray:
        """Of hashes of words; over all words of the corpus the chances sum to 1. A word that the corpus has not counts 0."""
        n = np.zeros(len(words))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
            n = np.where(self.keys[at] == words, self.n[at], 0.0)
        return (n + 0.5) / max(1.0, self.total + 0.5 * self.distinct)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every (doc_id, text), A-Z lower-cased: summed in each slice and each task before the shuffle."""

    def each(ids: list, texts: list[bytes]) -> dict[str, object]:
        n = Counter(b" ".join(texts).lower().split())
        return {"word": list(n.keys()), "n": list(n.values())}

    return map_texts(docs, "word binary, n bigint", each, slice_bytes=16 << 20).groupBy("word").agg(F.sum("n").alias("n"))


def shared_counts(docs: DataFrame, sample: list[bytes], scratch: Scratch) -> SharedCounts:
    """Exact counts over every text; the driver gets those of the sample's words."""
    counts = scratch.write(word_counts(docs), "shared-counts")
    size = counts.agg(F.sum("n").alias("total"), F.count("*").alias("words")).first()
    words = sorted({w for t in sample for w in t.lower().split()})
    if not words:
        return SharedCounts(np.empty(0, np.uint64), np.empty(0), size.total or 0, size.words)
    wanted = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(words, pa.binary())}))  # bounded by the sample
    found = counts.join(F.broadcast(wanted), "word").select("word", "n").toArrow()
    keys = np.array([xxhash.xxh64_intdigest(w) for w in found.column(0).to_pylist()], np.uint64)
    order = np.argsort(keys)
    return SharedCounts(keys[order], found.column(1).to_numpy().astype(float)[order], size.total, size.words)


class _Table:
    """Values by hash, and whether a hash is known. The hash table is built at the first lookup, so it is never sent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.places = keys, np.append(values, 0.0), None

    def __reduce__(self) -> tuple:
        return _Table, (self.keys, self.values[:-1])

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.places is None:
            self.places = HashTable(self.keys)
        at = self.places.get(keys)
        return self.values[at], at >= 0


class KneserNeyPair:
    """Log ratios toxic / ordinary: of bigrams, of words and of the backoff weights of the word before."""

    def __init__(self, texts: list[bytes], y: np.ndarray, shared: SharedCounts) -> None:
        words = [word_hashes(t) for t in texts]
        vocabulary = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]))
        _hashes.clear()
        rest_of = shared.chance(vocabulary)
        logs, weights, pairs, unseen = [], [], [], []
        for kind in (1, 0):
            own = [w for w, k in zip(words, y) if k == kind and len(w) > 2]
            runs = [np.concatenate([w[k : len(w) - 2 + k] for w in own] or [np.empty(0, np.uint64)]) for k in range(3)]
            # a bigram counts the different words before it, so what copies repeat counts once
            _, first = np.unique(_pairs(_pairs(runs[0], runs[1]), runs[2]), return_index=True)
            v, w = runs[1][first], runs[2][first]
            del own, runs
            found, first, n = np.unique(_pairs(v, w), return_index=True, return_counts=True)
            v, w = np.searchsorted(vocabulary, v[first]), np.searchsorted(vocabulary, w[first])
            size = len(vocabulary)
            kinds_before = np.bincount(w, minlength=size)  # different words before each word
            seen = np.bincount(v, weights=n, minlength=size)
            total = max(1, kinds_before.sum())
            left = discount(kinds_before).sum() / total if len(found) else 1.0
            word = (kinds_before - discount(kinds_before)) / total + left * rest_of
            weight = np.where(seen > 0, np.bincount(v, weights=discount(n), minlength=size) / np.maximum(seen, 1), 1.0)
            logs.append(np.log(word)), weights.append(weight)
            pairs.append((found, n, v, w, seen))
            unseen.append(np.log(left))
        self.unseen = unseen[0] - unseen[1]
        self.vocabulary = HashTable(vocabulary)
        self.words = np.append(logs[0] - logs[1], self.unseen)  # the last is of words that neither class has
        self.backoff = np.append(np.log(weights[0]) - np.log(weights[1]), 0.0)
        keys, first = np.unique(np.concatenate([p[0] for p in pairs]), return_index=True)
        v, w = (np.concatenate([p[k] for p in pairs])[first] for k in (2, 3))
        chance = []
        for k, (h, n, _, _, seen) in enumerate(pairs):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, h)] = n  # both sorted, and keys hold every h
            chance.append((count - discount(count)) / np.maximum(seen[v], 1) + weights[k][v] * np.exp(logs[k][w]))
        self.pairs = _Table(keys, np.log(chance[0]) - np.log(chance[1]))

    def ratios(self, words: np.ndarray) -> np.ndarray:
        """The log ratio of each word given the one before."""
        if not len(words):
            return np.zeros(0)
        at = self.vocabulary.get(words)
        out = self.words[at]
        if len(words) > 1:
            out[1:] += self.backoff[at[:-1]]
            value, known = self.pairs.get(pair_hashes(words))
            out[1:] = np.where(known, value, out[1:])
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean log ratio of a text, the largest of a word by itself, and the largest mean over RUN words."""
        out = np.zeros((len(texts), 3))
        words = [word_hashes(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        if not sizes.sum():
            return out
        joined = np.concatenate(words)
        every, alone = self.ratios(joined), self.words[self.vocabulary.get(joined)]
        for k, (end, n) in enumerate(zip(np.cumsum(sizes), sizes)):
            if n:
                r, single = every[end - n : end].copy(), alone[end - n : end]
                r[0] = single[0]  # no word before it
                total = np.concatenate([[0.0], np.cumsum(r)])
                run = min(RUN, n)
                out[k] = r.mean(), single.max(), (total[run:] - total[:-run]).max() / run
        return out


class ToxicityModel:
    def __init__(self, texts: list[bytes], y: np.ndarray, shared: SharedCounts) -> None:
        self.base = float(y.mean()) if len(y) else 0.5
        self.pair = None
        if len(set(y.tolist())) == 2:
            # halves by turns: a text's features come from models that have not seen it
            self.weights = self._calibrated(texts, y, shared)
            self.pair = KneserNeyPair(texts, y, shared)

    @staticmethod
    def _calibrated(texts: list[bytes], y: np.ndarray, shared: SharedCounts) -> np.ndarray:
        x = np.zeros((len(texts), 3))
        fold = np.arange(len(texts)) % 3
        for k in range(3):
            rest = [i for i in range(len(texts)) if fold[i] != k]
            model = KneserNeyPair([texts[i] for i in rest], y[rest], shared)
            at = np.flatnonzero(fold == k)
            x[at] = model.features([texts[i] for i in at])
            del model  # before the next one is built
        return logistic(x, y, ridge=1e-2)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.pair is None:
            return np.full(len(texts), self.base)
        return probability(self.pair.features(texts), self.weights)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``."""
    texts = picked(docs, id_col, text_col)
    sample, y = labelled_sample(docs, labels, label_col, PER_CLASS, MOST_BYTES, id_col, text_col, whole_words=True)
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        shared = shared_counts(texts, sample, scratch)
    model = ToxicityModel(sample, y, shared)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    scored = map_texts(texts, "doc_id bigint, score double", lambda ids, t: {"doc_id": ids, "score": held.value.scores(t)})
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
