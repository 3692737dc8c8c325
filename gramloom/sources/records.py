"""A Spark data source of binary count files: format "ngram_records", records as in sources.binary.

Files are read by ranges of bytes, so that one of any size is many tasks; the options `first` and `last` bound the first
id, and as records are sorted, a task finds where they lie by bisection and reads nothing else. A writer's tasks write
beside the folder's files, and its commit puts them in place; what failed or lost tasks leave behind goes with it.

Paths are opened by pyarrow (local and shared folders, hdfs, s3, gs); where a file system is known to the JVM only,
`binary.read_counts` reads whole files instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gramloom.sources.binary import record_type

#: Bytes of a file that one task reads, and records of a batch.
SPAN, BATCH = 128 << 20, 100_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The path's file system and the path there; file: with one slash is as good as with three."""
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Span(InputPartition):
    file: str
    begin: int  # record numbers from 0, end excluded
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options["n"])
        self.span = int(options.get("span", SPAN))
        self.first, self.last = int(options.get("first", -(2**31))), int(options.get("last", 2**31 - 1))

    def partitions(self) -> list[Span]:
        files, at = _opened(self.path)
        size, out = record_type(self.n).itemsize, []
        for f in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith((".", "_")):
                continue
            if f.size % size:
                raise ValueError(f"{f.path} has no whole number of records of {self.n} ids")
            step = max(1, self.span // size)
            out += [Span(f.path, k, min(k + step, f.size // size)) for k in range(0, f.size // size, step)]
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        kind = record_type(self.n)
        files, _ = _opened(self.path)
        with files.open_input_file(partition.file) as f:
            some = lambda a, b: np.frombuffer(f.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)

            def place(least: int) -> int:
                """The first record of the span whose first id is not less."""
                lo, hi = partition.begin, partition.end
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if int(some(mid, mid + 1)["w1"][0]) < least else (lo, mid)
                return lo

            begin, end = place(self.first), place(self.last + 1)
            for k in range(begin, end, BATCH):
                rows = some(k, min(k + BATCH, end))
                columns = [pa.array(np.ascontiguousarray(rows[c])) for c in kind.names]
                name = pa.array([partition.file.rsplit("/", 1)[-1]] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(k + 1, k + 1 + len(rows))), *columns], ["file", "rid", *kind.names])


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.n, self.overwrite, self.job = options["path"], int(options["n"]), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        kind, before, out = record_type(self.n), None, None
        files, at = _opened(self.path)
        words = kind.names[:-1]
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if any(batch.column(c).null_count for c in kind.names):
                    raise ValueError("records have no nulls")
                rows = np.zeros(batch.num_rows, kind)
                for c in kind.names:
                    rows[c] = batch.column(c).to_numpy()
                both = rows if before is None else np.concatenate([before, rows])
                more = np.zeros(len(both) - 1, bool)  # whether a record is greater than the one before it
                for c in reversed(words):
                    more = (both[c][1:] > both[c][:-1]) | ((both[c][1:] == both[c][:-1]) & more)
                if not more.all():
                    raise ValueError("records of a file are sorted and each is there once")
                if out is None:
                    files.create_dir(f"{at}/.new-{self.job}", recursive=True)
                    out = files.open_output_stream(f"{at}/.new-{self.job}/{name}")
                out.write(rows.tobytes())
                before = rows[-1:]
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _opened(self.path)
        files.create_dir(at, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            if m is not None and m.file:
                files.move(f"{at}/.new-{self.job}/{m.file}", f"{at}/{m.file}")
        for path in old:
            files.delete_file(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, at = _opened(self.path)
        if files.get_file_info(f"{at}/.new-{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{at}/.new-{self.job}")


class RecordSource(DataSource):
    """Options: path; n, the ids of a record; span, bytes of a task; first and last, bounds of the first id."""

    @classmethod
    def name(cls) -> str:
        return "ngram_records"

    def schema(self) -> str:
        return "file string, rid long, " + ", ".join(f"w{i} int" for i in range(1, int(self.options["n"]) + 1)) + ", count long"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options, overwrite)


def read_records(spark: SparkSession, path: str, n: int, first: int | None = None, last: int | None = None, span: int = SPAN) -> DataFrame:
    """file, rid (from 1 within its file), w1..wn, count of the records whose first id is in first..last; a folder without
    files has none."""
    spark.dataSource.register(RecordSource)
    told = {"n": n, "span": span, "first": first, "last": last}
    return spark.read.format("ngram_records").options(**{k: v for k, v in told.items() if v is not None}).load(path)


def write_records(counts: DataFrame, path: str, n: int, parts: int, mode: str = "append") -> None:
    """w1..wn, count (each n-gram once, no nulls) as at most `parts` files, each a range of n-grams, in the order of their names."""
    counts.sparkSession.dataSource.register(RecordSource)
    words = [f"w{i}" for i in range(1, n + 1)]
    rows = counts.select(*(counts[w].cast("int").alias(w) for w in words), counts["count"].cast("long").alias("count"))
    rows.repartitionByRange(parts, *words).sortWithinPartitions(*words).write.format("ngram_records").option("n", n).mode(mode).save(path)
