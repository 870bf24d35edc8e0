"""A sink for reports: JSON lines or a Markdown table, as a Python data source with commit and abort.

Each attempt of a task writes a file of its own and says which; only what the driver is told of by the attempts that
counted is put in place, so a task that failed and ran again leaves no row twice, and a job that failed leaves nothing.
Paths may be of any file system that Arrow knows, shared by driver and executors. Rows stand in the order of
their partitions, so a sorted table stays sorted. Names follow from the partitions, so the same report written again
has the same files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import FractionalType, IntegralType, StructType

NAME = "vellum_report"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(options["path"])
        self.layout = options.get("layout", "json")
        if self.layout not in ("json", "markdown"):
            raise ValueError(f"layout is json or markdown, not {self.layout}")
        self.title, self.digits = options.get("title"), int(options.get("digits", "1"))
        self.schema, self.overwrite = schema, overwrite
        self.work = f"{self.folder}/_work-{uuid.uuid4().hex}"
        self.store.create_dir(self.work, recursive=True)

    def line(self, row: Row) -> str:
        if self.layout == "json":
            return json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str)
        shown = lambda v, kind: "" if v is None else f"{v:.{self.digits}f}" if isinstance(kind, FractionalType) else str(v).replace("|", "\\|").replace("\n", " ")
        return "| " + " | ".join(shown(v, f.dataType) for v, f in zip(row, self.schema)) + " |"

    def write(self, iterator: Iterator[Row]) -> Written:
        task = TaskContext.get()
        file, n = f"{self.work}/part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        with self.store.open_output_stream(file) as out:
            for row in iterator:
                out.write((self.line(row) + "\n").encode())
                n += 1
        return Written(task.partitionId(), file, n)

    def head(self) -> str:
        number = lambda f: isinstance(f.dataType, (IntegralType, FractionalType))
        title = f"# {self.title}\n\n" if self.title else ""
        return f"{title}| {' | '.join(f.name for f in self.schema)} |\n|{'|'.join('---:' if number(f) else '---' for f in self.schema)}|\n"

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        if self.overwrite:
            for old in self.store.get_file_info(fs.FileSelector(self.folder)):
                if old.base_name.startswith(("part-", "report.md", "_SUCCESS")):
                    self.store.delete_file(old.path)
        if self.layout == "json":
            for m in done:
                self.store.move(m.file, f"{self.folder}/part-{m.partition:05d}.json")
        else:
            whole = f"{self.work}/report"
            with self.store.open_output_stream(whole) as out:  # a table of parts of any number, a block at a time
                out.write(self.head().encode())
                for m in done:
                    with self.store.open_input_stream(m.file) as part:
                        while block := part.read(1 << 20):
                            out.write(block)
            self.store.move(whole, f"{self.folder}/report.md")
        with self.store.open_output_stream(f"{self.folder}/_SUCCESS") as out:
            out.write(json.dumps({"rows": sum(m.rows for m in done), "parts": len(done)}).encode())
        self.store.delete_dir(self.work)

    def abort(self, messages: list[Written | None]) -> None:
        self.store.delete_dir(self.work)


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), schema, overwrite)


def write_report(df: DataFrame, path: str, layout: str = "json", title: str | None = None, digits: int = 1) -> None:
    """Write ``df`` as JSON lines (a file for each partition) or as one Markdown table, in place of what is there."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(ReportSink)
    out = df.write.format(NAME).option("layout", layout).option("digits", digits).mode("overwrite")
    (out.option("title", title) if title else out).save(path)
