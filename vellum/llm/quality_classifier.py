"""Quality classifier by compression.

Two Zstandard dictionaries are built, from good and from bad labelled texts. A
text is cut into blocks of :data:`BLOCK` bytes, each compressed once with either
dictionary; the difference of the two sizes over the text's bytes is the one
feature, and a logistic fit on the labelled sample turns it into a probability.
Blocks cover the whole text.

Fitted on at most :data:`PER_CLASS` rows of each label, none held out; every row
is scored. The logistic fit sees each sample text's difference under dictionaries
built from the other half of the sample.

Defined results: a null or empty text has difference 0; without rows of both
labels every score is the share of label 1 (0.5 without rows); repeated rows each
get their row.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F

from vellum.llm.labelled import labelled_sample, logistic, probability
from vellum.llm.rows import held_out, map_texts, picked

#: Bound of the sample: rows of each label, and bytes of a text that is fitted on.
PER_CLASS, MOST_BYTES = 1500, 32_768
#: Bytes of a block and of a dictionary, Zstandard's level, score from which label 1 is predicted.
BLOCK, DICTIONARY, LEVEL, PREDICTED_FROM = 512, 65_536, 1, 0.3


def blocks(text: bytes) -> list[bytes]:
    return [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]


class CompressionModel:
    """Two dictionaries and the calibration; compressors are made in the process that uses them."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, base: float) -> None:
        self.good, self.bad, self.weights, self.base = good, bad, weights, base
        self._pair: list | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_pair": None}

    def difference(self, text: bytes) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text."""
        if self._pair is None:
            self._pair = []
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        good, bad = self._pair
        parts = blocks(text)
        return sum(len(bad(x)) - len(good(x)) for x in parts) / max(1, len(text))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.base)
        return probability(np.array([[self.difference(t)] for t in texts]).reshape(-1, 1), self.weights)


def dictionaries(texts: list[bytes], y: np.ndarray) -> list[bytes]:
    """That of the texts with label 1, and that of the others."""
    data = []
    for kind in (1, 0):
        samples = [b for t, k in zip(texts, y) if k == kind for b in blocks(t)]
        try:
            data.append(zstandard.train_dictionary(DICTIONARY, samples).as_bytes())
        except zstandard.ZstdError:  # too few samples to train on: the samples themselves are the dictionary
            data.append(b"".join(samples)[-DICTIONARY:] or b"\0" * 8)
    return data


def fit(texts: list[bytes], y: np.ndarray) -> CompressionModel:
    base = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return CompressionModel(b"", b"", np.zeros(2), base)
    x, half = np.zeros((len(texts), 1)), np.arange(len(texts)) % 2
    for k in (0, 1):
        rest, own = np.flatnonzero(half != k), np.flatnonzero(half == k)
        data = dictionaries([texts[i] for i in rest], y[rest])
        other = CompressionModel(*data, np.zeros(2), base)
        x[own, 0] = [other.difference(texts[i]) for i in own]
    return CompressionModel(*dictionaries(texts, y), logistic(x, y), base)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``."""
    model = fit(*labelled_sample(docs, labels, label_col, PER_CLASS, MOST_BYTES, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes
    scored = map_texts(picked(docs, id_col, text_col), "doc_id bigint, score double", lambda ids, texts: {"doc_id": ids, "score": shared.value.scores(texts)})
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))
