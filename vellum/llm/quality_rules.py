"""Quality rules with a hashed n-gram log-likelihood ratio. Native.

Base figures of each text come from array functions on its words, with no shuffle.
The method compares two multinomials over hashed word unigrams and bigrams: one
of trusted text, one of the raw corpus, both counted over all their rows and
smoothed by adding :data:`ADD` to each of :data:`BUCKETS` counts. A document's
score is the mean over its n-grams of log(trusted / raw); below
:data:`THRESHOLD` the verdict is to drop it. Trusted are texts that pass the strict
form of the base rules (:func:`is_trusted`), so no join moves the texts.

The model is BUCKETS whole numbers whatever the input: log ratios in thousandths,
so that sums are exact. Plans carry it as a literal.

Defined results: a null text counts as empty; an empty text has no words, scores
0 and fails the base rules; repeated rows each get their row; null ids are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.rows import GAPS, picked
from vellum.sources.scratch import Scratch

#: Hash buckets, count added to each, mean log ratio below which a document goes.
BUCKETS, ADD, THRESHOLD = 16384, 0.5, -0.08
#: Base rules: fewest words, percentage of words in repeated windows, words of a window.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, GAPS), "")


def _joined(hashes: Column, apart: int) -> Column:
    """A hash of each element and the one ``apart`` places before it, in order; elements without one before are passed over."""
    n = F.size(hashes) - apart
    both = F.zip_with(F.slice(hashes, apart + 1, F.greatest(n, F.lit(0))), F.slice(hashes, 1, F.greatest(n, F.lit(0))), lambda now, before: F.xxhash64(now, before))
    return F.when(n > 0, both).otherwise(F.array().cast("array<bigint>"))


def _with_repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words in windows of WINDOW = 8 whose hash occurs twice or more.

    Pairs of neighbouring words make runs of four, and these make windows. A window
    that occurs twice has a run of four that does, so most texts stop there. Sorted
    by hash, equal windows stand side by side; their sorted starts each cover the
    words up to the next start. Each step is a column of its own, as a lambda
    evaluates what it names anew for each element.
    """
    df = df.withColumn("_fours", _joined(F.col("pairs"), 2))
    repeated = F.size("_fours") > F.size(F.array_distinct("_fours"))
    df = df.withColumn("_windows", F.when(repeated, _joined(F.col("_fours"), 4)).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    df = df.withColumn("_sorted", F.when(repeated, F.array_sort(placed)))
    same = lambda i, j: F.coalesce(F.get("_sorted", i)["h"] == F.get("_sorted", j)["h"], F.lit(False))
    df = df.withColumn("_starts", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["at"])))
    gaps = F.transform("_starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - at, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0))).drop("_fours", "_windows", "_sorted", "_starts")


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, words and the base figures of each text that need no windows."""
    df = picked(docs, id_col, text_col).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", F.when(F.contains("text", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")))
    return df.select(
        "doc_id", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )


def with_rules(df: DataFrame) -> DataFrame:
    """Add hashes, pairs, n_repeat_words and base_failed to :func:`figures`."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = _with_repeats(df.withColumn("pairs", _joined(F.col("hashes"), 1)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def is_trusted() -> Column:
    """Whether a text's figures make it target text: long enough, varied, without repeated lines, symbols or shouting."""
    n = F.col("n_words")
    varied = 2 * F.size(F.array_distinct("words")) >= n
    calm = (50 * F.col("n_symbols") <= n) & (20 * (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))) <= n)
    return (n >= 50) & varied & (F.col("n_dup_lines") == 0) & calm


def train(docs: DataFrame, scratch: Scratch, trusted: Column | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """1000 * log(trusted / raw) of each bucket. Counts cover every text; ``trusted`` may use the columns of :func:`figures`."""
    df = figures(docs, id_col, text_col).select("words", (is_trusted() if trusted is None else trusted).cast("int").alias("good"))
    # a word and the one after it, so that hashes and buckets are worked out in compiled code
    neighbours = F.arrays_zip(F.col("words").alias("now"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("after"))
    each = df.select(F.explode(neighbours).alias("w"), "good").select("w.now", "w.after", "good")
    now, pair = F.xxhash64("now"), F.when(F.col("after").isNotNull(), F.xxhash64(F.xxhash64("after"), F.xxhash64("now")))
    each = each.select(F.explode(F.array(F.pmod(now, F.lit(buckets)), F.pmod(pair, F.lit(buckets)))).alias("bucket"), "good").where("bucket IS NOT NULL")
    counts = scratch.write(each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")), "counts")
    rows = counts.collect()  # at most ``buckets`` rows
    raw, target = [ADD] * buckets, [ADD] * buckets
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    base = math.log(math.fsum(target)) - math.log(math.fsum(raw))
    return [round(1000 * (math.log(t) - math.log(n) - base)) for t, n in zip(target, raw)]


def scored(docs: DataFrame, model: list[int], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The contract's columns and ``score``, a row for each row of ``docs``."""
    df = with_rules(figures(docs, id_col, text_col))
    return _verdict(df, model, threshold, buckets).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _verdict(df: DataFrame, model: list[int], threshold: float, buckets: int) -> DataFrame:
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<bigint>")  # folded into one literal
    ratio = lambda h: F.get(ratios, F.pmod(h, F.lit(buckets)).cast("int"))
    total = sum((F.aggregate(c, F.lit(0).cast("long"), lambda a, h: a + ratio(h)) for c in ("hashes", "pairs")), F.lit(0).cast("long"))
    grams = F.size("hashes") + F.size("pairs")
    df = df.withColumn("score", F.when(grams > 0, total / grams / 1000).otherwise(0.0))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``docs`` and judge every one of them."""
    with Scratch(docs.sparkSession, "quality-rules") as scratch:
        model = train(docs, scratch, id_col=id_col, text_col=text_col)
    return scored(docs, model, id_col, text_col, threshold)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, without the rejected rows."""
    with Scratch(docs.sparkSession, "quality-rules") as scratch:
        model = train(docs, scratch, id_col=id_col, text_col=text_col)
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    judged = _verdict(with_rules(figures(whole, "row", "text")), model, threshold, BUCKETS)
    # the id is not deterministic, which keeps the filter above the columns it reads instead of working them out twice
    return judged.select("doc_id", "kept", F.monotonically_increasing_id().alias("_pin")).where("kept AND _pin >= 0").select("doc_id.*")
