"""Bounded samples of labelled texts, and a logistic fit on few features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from vellum.llm.rows import GAPS, WORD, held_out, picked


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = False) -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of at most ``per_class`` rows of each label, taken in the order of a hash of the id.

    Held-out rows, null labels and ids with both labels are passed over. Of a text
    above ``most_bytes`` one block stands in the sample, of a quarter as many
    characters, at a place that a hash of the id draws; its row is scored whole. With
    ``whole_words`` the block ends at word gaps: words that it would cut are left out, and
    a row whose block has no whole word is not in the sample.
    The driver holds at most 2 * per_class * most_bytes.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].union(parts[1])  # 2 * per_class ids
    texts = picked(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    size = most_bytes // 4  # characters have four bytes at most
    start = F.pmod(F.xxhash64("doc_id"), F.floor(F.length("text") / size) + 1) * size + 1
    start = F.least(start, F.length("text") - size + 1).cast("int")
    block = F.col("text").substr(start, F.lit(size))
    if whole_words:
        apart = lambda at: F.rlike(F.col("text").substr(at, F.lit(1)), F.lit(f"^{GAPS}"))
        block = F.when((start == 1) | apart(start - 1), block).otherwise(F.regexp_replace(block, f"^{WORD}", ""))
        block = F.when((start + size > F.length("text")) | apart(start + size), block).otherwise(F.regexp_replace(block, rf"(?<![^\x20\x09-\x0D]){WORD}$", ""))
        texts = texts.where((F.octet_length("text") <= most_bytes) | F.rlike(block, F.lit(WORD)))
    block = F.when(F.octet_length("text") <= most_bytes, F.col("text")).otherwise(block)
    rows = texts.select("doc_id", "label", block.alias("text")).groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.label, r.doc_id))
    return [r.text.encode() for r in rows], np.array([r.label for r in rows], int)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))
