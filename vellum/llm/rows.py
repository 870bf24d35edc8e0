"""What the operators of this subpackage share about rows.

An operator takes the table, the names of its id and text columns, and picks
those two columns first, so that further columns, whatever their names, do no
harm.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The characters that part words: \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAPS = r"[\x20\x09-\x0D]+"


def picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of ``df``, a null text as the empty one."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lowered(text: Column) -> Column:
    """A-Z lower-cased and no other letter: the quick built-in serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Bytes of a batch that goes to a Python worker, in place of Spark's 64 MB.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for Python workers, unless the session has a size of its own: a worker holds a batch several times over.

    The setting holds for the session from then on, as Spark reads it when a plan runs and not when it is made.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if setting not in spark.conf.getAll:
        spark.conf.set(setting, str(BATCH_BYTES))


def at_task_end(clear: Callable[[], None]) -> None:
    """Have ``clear`` called when the running task ends, and memory given back: idle workers stay, and other tasks need the room."""
    _cleared.add(clear)


_cleared: set[Callable[[], None]] = set()


def end_task() -> None:
    """What the maps of this module call when they have seen all their rows."""
    for clear in _cleared:
        clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def map_texts(df: DataFrame, schema: str, each: Callable[[list, list[bytes]], dict[str, object]], slice_bytes: int = 4 << 20) -> DataFrame:
    """Arrow map over (doc_id, text): ``each`` gets ids and UTF-8 texts of a slice and returns its columns.

    A slice holds at most ``slice_bytes`` of text or a single document, so a run
    of long documents does not raise a worker's memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    want = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(texts).to_pylist()
            start = 0
            while start < len(sizes):
                end, total = start, 0
                while end < len(sizes) and (end == start or total + sizes[end] <= slice_bytes):
                    total += sizes[end]
                    end += 1
                out = each(ids.slice(start, end - start).to_pylist(), texts.slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in want], schema=want)
                start = end
        end_task()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
