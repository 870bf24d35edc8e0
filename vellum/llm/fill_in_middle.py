"""Fill-in-middle: texts rearranged so that a model learns to fill gaps.

A text is cut into units (code points, unless another pattern is given). Two cuts,
drawn from a hash of seed and id, part it into prefix, middle and suffix at unit
ends; marks name the parts. Of two forms ``psm`` puts the prefix first, ``spm`` the
suffix. A share of the texts stays plain, as do texts that hold a mark already, so
that :func:`restored` always gives the exact text back.

An Arrow-batched pandas UDF does this: the unit pattern's matches give their end
offsets into a compact array, two lookups in it slice the text, and hashlib makes
seeds and digests. Units of a fixed width are matched in runs of :data:`RUN`, whose
ends follow from the run's: a match object for each code point took 1,330 CPU
seconds a GB by itself. A worker holds a batch of :data:`vellum.llm.rows.BATCH_BYTES` and
four bytes for each unit of one text.

Defined results: a null text counts as empty, an empty text is plain with n = 0; a
null id hashes as the empty id; repeated rows each get the same row; units are
matched left to right and what no unit covers (patterns that leave gaps) goes with
the unit after it, or with the suffix at the end; further columns do no harm, as
only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import methodcaller
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from vellum.llm.rows import picked, small_batches

#: Marks of prefix, suffix and middle; percentages of texts rearranged, and of those in form spm.
MARKS = ("<P>", "<S>", "<M>")
RATE, SPM_RATE = 90, 20
#: Units that one match takes in where they all have the same width.
RUN = 65_536


class Unit(NamedTuple):
    """What a text is cut into: a pattern, and the width of its matches in code points where that is fixed."""

    pattern: str
    width: int | None = None


#: Code points; words with the space before them; lines.
CODE_POINTS, WORDS, LINES = Unit(r"(?s).", 1), Unit(r"\s*\S+"), Unit(r"[^\n]*\n|[^\n]+")

PARTS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"

_end = methodcaller("end")


def draws(doc_id: int | str | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit draws: the first groups of eight hex digits of the SHA-256 of ``seed:id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))  # type: ignore[return-value]


def matcher(unit: Unit) -> regex.Pattern:
    return regex.compile(unit.pattern if unit.width is None else f"(?:{unit.pattern}){{1,{RUN}}}")


def unit_ends(text: str, pattern: regex.Pattern, width: int | None) -> np.ndarray:
    """End offsets of a text's units, in code points; offset 0 stands before them."""
    if width is None:
        ends = [np.fromiter(map(_end, pattern.finditer(text)), np.uint32)]
    else:
        ends = [np.arange(m.start() + width, m.end() + 1, width, dtype=np.uint32) for m in pattern.finditer(text)]
    return np.concatenate([np.zeros(1, np.uint32), *ends])


def rearranged(doc_id: int | str | None, text: str, pattern: regex.Pattern, width: int | None, seed: int, rate: int, spm_rate: int) -> tuple:
    """A row of :data:`PARTS`."""
    ends = unit_ends(text, pattern, width)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text, hashlib.sha256(text.encode()).hexdigest()
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(ends[first]), int(ends[second])
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    form = "spm" if h4 % 100 < spm_rate else "psm"
    out = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, form, a, b - a, out, hashlib.sha256(out.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, unit: Unit = CODE_POINTS, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256: a row for each row of ``docs``.

    ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of these as spm.
    """

    @F.pandas_udf(PARTS)
    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = matcher(unit)
        names = [c.split()[0] for c in PARTS.split(", ")]
        for ids, texts in batches:
            rows = [rearranged(i, t, pattern, unit.width, seed, rate, spm_rate) for i, t in zip(ids, texts)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    small_batches(docs.sparkSession)
    # the id goes as text, as pandas would turn a batch of numbers with a null into floats
    rows = picked(docs, id_col, text_col)
    return rows.select("doc_id", parts(F.col("doc_id").cast("string"), "text").alias("p")).select("doc_id", "p.*")


def restored(form: Column, output: Column) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of: its parts stand between the marks, of which it has each once."""
    part = F.split(output, "|".join(MARKS), -1)  # what stands before the first mark is empty
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, places in order.items():
        out = out.when(form == name, F.concat(*[F.get(part, F.lit(k)) for k in places]))
    return out


@F.pandas_udf(StringType())
def sha256_hex(texts: pd.Series) -> pd.Series:
    """Lower-case hex SHA-256 of each text in UTF-8."""
    return pd.Series([None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts], dtype="object")


def round_trip(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from form and output."""
    out = fill_in_middle(docs, **options)  # type: ignore[arg-type]
    again = sha256_hex(restored(F.col("form"), F.col("output")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", again.alias("restored_sha256"))
