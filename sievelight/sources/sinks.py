"""Sinks. Spark commits whole jobs, so a reader sees all of a batch or nothing of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def json_results(results: DataFrame, path: str, compression: str = "gzip") -> None:
    """page_id, labels, html, markdown, error as JSON lines; characters beyond ASCII stay as they are."""
    rows = results.select("page_id", "labels", F.col("main_html").alias("html"), "markdown", "error")
    rows.write.option("compression", compression).option("ignoreNullFields", "false").json(path)


def parquet_results(results: DataFrame, path: str, shard: str | None = None, compression: str = "zstd") -> None:
    """Results without what only inference needs, by shard if there is a column for it."""
    slim = results.drop("chunks", "blocks", "simplified_html", "map_html")
    writer = slim.write.option("compression", compression).mode("append")
    (writer.partitionBy(shard) if shard else writer).parquet(path)


def scores(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Scores as readers.scores() reads them, so that pages are scored once."""
    from .readers import SCORE

    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCORE]).write.mode(mode).parquet(path)


def mark_done(keys: DataFrame, path: str) -> None:
    """Appends keys to the table of what is done."""
    keys.distinct().write.mode("append").parquet(path)


@dataclass
class _Written(WriterCommitMessage):
    file: str


class _ZstdLinesWriter(DataSourceArrowWriter):
    """Tasks write files under names of their own in a folder beside the table's; the commit moves the files of those that count."""

    def __init__(self, path: str, level: int, overwrite: bool):
        self.path, self.level, self.overwrite, self.work = path.rstrip("/"), level, overwrite, f"{path.rstrip('/')}/_work-{uuid.uuid4().hex}"

    def _system(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.jsonl.zst"
        system, work = self._system(self.work)
        system.create_dir(work)
        with system.open_output_stream(f"{work}/{name}", compression=None) as raw, zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False) as out:
            for batch in iterator:
                out.write(b"".join((line or "").encode() + b"\n" for line in batch.column("line").to_pylist()))
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, target = self._system(self.path)
        work = self._system(self.work)[1]
        if self.overwrite:
            for old in system.get_file_info(_inside(target)):
                if old.base_name.startswith("part-"):
                    system.delete_file(old.path)
        for message in messages:
            if message is not None:
                system.move(f"{work}/{message.file}", f"{target}/{message.file.replace('part-', f'part-{self.work[-8:]}-')}")
        self._end(system, work)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, work = self._system(self.work)
        self._end(system, work)

    @staticmethod
    def _end(system, work: str) -> None:
        if system.get_file_info(work).type.name != "NotFound":
            system.delete_dir(work)


def _inside(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


class ZstdLines(DataSource):
    """Lines of text as zstd files, in a folder that all tasks reach through pyarrow's file systems. Options: path, level."""

    @classmethod
    def name(cls) -> str:
        return "zstd-lines"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ZstdLinesWriter(self.options["path"], int(self.options.get("level", "10")), overwrite)


def zstd_json(rows: DataFrame, path: str, level: int = 10, mode: str = "append") -> None:
    """rows as JSON lines in zstd files, which Spark's own text sinks don't write; null fields stay, characters beyond ASCII too."""
    rows.sparkSession.dataSource.register(ZstdLines)
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("line"))
    lines.write.format("zstd-lines").option("path", path).option("level", str(level)).mode(mode).save()
