"""Shared counts and bigrams of the toxicity models."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np

from vellum.llm import toxicity as X
from vellum.llm.labelled import labelled_sample
from vellum.sources.scratch import Scratch


def test_shared_counts_are_exact_beyond_any_number_of_slots(spark):
    texts = [" ".join(f"W{i}" for i in range(k * 10_000, (k + 1) * 10_000)) + " rare" * (k == 3) + " common" * 100 for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with Scratch(spark, "test") as scratch:
        shared = X.shared_counts(docs, [b"rare w7 COMMON", b""], scratch)
    assert (shared.total, shared.distinct) == (300_000 + 1 + 3_000, 300_002)
    assert shared.chance(X.word_hashes(b"rare w7 common")).tolist() == [(n + 0.5) / (303_001 + 150_001) for n in (1, 1, 3_000)]


def test_every_bigram_of_the_sample_is_kept():
    texts = [b"so vile poison came here", b"a vile poison is that", b"the good day came here", b"one good night came here"]
    words = np.unique(np.concatenate([X.word_hashes(t) for t in texts]))
    pair = X.KneserNeyPair(texts, np.array([1, 1, 0, 0]), X.SharedCounts(words, np.ones(len(words)), 1000, 500))
    for bigram, sign in ((b"vile poison", 1), (b"good day", -1)):  # only one class has the first word, and fewer than 8 times
        value, known = pair.pairs.get(X.pair_hashes(X.word_hashes(bigram)))
        assert known.all() and np.sign(value[0]) == sign


def plain_ratios(texts: list[str], y: list[int], corpus: list[str]) -> object:
    """A function word list -> log ratios, by dictionaries: interpolated Kneser-Ney over distinct trigram starts, with shared unigrams below."""
    count = collections.Counter(w for t in corpus for w in t.lower().split())
    total, distinct = sum(count.values()), len(count)
    rest = lambda w: (count[w] + 0.5) / (total + 0.5 * distinct)
    cut = lambda n: (0.0, 0.9, 1.5, 2.0)[min(n, 3)]
    sample = {w for t in texts for w in t.lower().split()}
    models = []
    for kind in (1, 0):
        own = [t.lower().split() for t, k in zip(texts, y) if k == kind]
        thirds = {tuple(w[i : i + 3]) for w in own for i in range(len(w) - 2)}
        pairs = collections.Counter((b, c) for _, b, c in thirds)
        before = collections.Counter(c for _, c in pairs)
        starts = collections.defaultdict(list)
        for (b, _), n in pairs.items():
            starts[b].append(n)
        types = sum(before.values())
        left = sum(map(cut, before.values())) / types
        word = lambda w, before=before, types=types, left=left: (before[w] - cut(before[w])) / types + left * rest(w) if w in sample else left
        weight = lambda b, starts=starts: sum(map(cut, starts[b])) / sum(starts[b]) if b in starts else 1.0
        models.append((pairs, starts, word, weight))

    def ratios(words: list[str]) -> list[float]:
        out = []
        for i, w in enumerate(words):
            one = []
            for pairs, starts, word, weight in models:
                if i == 0:
                    one.append(word(w))
                else:
                    b = words[i - 1]
                    seen = (pairs[b, w] - cut(pairs[b, w])) / sum(starts[b]) if b in starts else 0.0
                    one.append(seen + weight(b) * word(w))
            out.append(math.log(one[0] / one[1]))
        return out

    return ratios


def test_ratios_equal_plain_kneser_ney(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(vocabulary[:22] if k % 2 else vocabulary[8:]) for _ in range(r.randrange(0, 40))) for k in range(40)]
    y = [k % 2 for k in range(40)]
    corpus = texts + [" ".join(r.choice(vocabulary + ["W3", "rare"]) for _ in range(50)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    with Scratch(spark, "test") as scratch:
        shared = X.shared_counts(docs, [t.encode() for t in texts], scratch)
    pair = X.KneserNeyPair([t.encode() for t in texts], np.array(y), shared)
    want = plain_ratios(texts, y, corpus)
    for text in [*texts, *corpus[-10:], "w1 unknown w2", "unknown"]:
        words = text.lower().split()
        assert np.allclose(pair.ratios(X.word_hashes(text.encode())), want(words))
        if words:
            r8, n = want(words), min(X.RUN, len(words))
            alone = [want([w])[0] for w in words]
            features = (sum(r8) / len(r8), max(alone), max(sum(r8[i : i + n]) / n for i in range(len(r8) - n + 1)))
            assert np.allclose(pair.features([text.encode()])[0], features)


def long_rows() -> tuple[list[tuple], list[tuple]]:
    """Labelled texts above the block of the sample: of one word, of many, and one whose only gap lies outside any block."""
    r = random.Random(8)
    texts = [(k, "x" * 40_000 + str(k)) for k in range(12)]
    texts += [(k, " ".join(f"w{r.randrange(30_000)}" for _ in range(12_000))) for k in range(12, 24)]
    texts += [(24, "y" * 50_000 + " end"), (25, "é" * 33_000)]
    texts += [(k, f"plain words number {k} of a short text") for k in range(26, 80)]
    return texts, [(k, k % 2) for k, _ in texts]


def test_long_labelled_texts_of_one_word_and_of_many(spark):
    texts, y = long_rows()
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")
    rows = X.classify(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)


def test_sample_blocks_have_whole_words_alone(spark):
    texts, y = long_rows()
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(y, "doc_id long, toxic int")
    sample, _ = labelled_sample(docs, labels, "toxic", X.PER_CLASS, X.MOST_BYTES, whole_words=True)
    corpus = {w for _, t in texts for w in t.encode().split()}
    assert all(w in corpus for t in sample for w in t.split()) and all(t.split() for t in sample)
    many = [t for t in sample if len(t.split()) > 500]
    assert len(many) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(12, 24))
    assert not any(len(w) > 30_000 for t in sample for w in t.split())


def test_words_without_counts_take_no_other_words_count():
    words = np.sort(X.word_hashes(b"alpha beta gamma"))
    shared = X.SharedCounts(words, np.array([5.0, 7.0, 9.0]), 21, 3)
    assert shared.chance(X.word_hashes(b"stranger other")).tolist() == [0.5 / 22.5] * 2
    assert shared.chance(np.array([np.iinfo(np.uint64).max, 0], np.uint64)).tolist() == [0.5 / 22.5] * 2
    empty = X.SharedCounts(np.empty(0, np.uint64), np.empty(0), 0, 0)
    assert empty.chance(words).tolist() == [0.5] * 3
    X.KneserNeyPair([b"a b c", b"d e f"], np.array([1, 0]), empty)
