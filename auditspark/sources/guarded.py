"""A data source for tables that only whole results replace: df.write.format("guarded"), spark.read.format("guarded").

Tasks write Parquet files beside the versions of the table and return a message with the file and its rows. The commit looks
whether each file is there with that many rows, removes what tasks that failed or ran twice have left, counts, and makes
the folder the newest version v=<n> by one rename. A killed task, a short write or a lost file leaves the versions as they
were. Written versions can be read by sources.tables.published too. Renames must be atomic (local disks, HDFS); a table has
one writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from auditspark.session import ship_package


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(Guarded)


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":" in path else f"file://{path}")


def _versions(fs, path: str) -> list[int]:
    from pyarrow.fs import FileSelector, FileType

    found = [f.base_name for f in fs.get_file_info(FileSelector(path, allow_not_found=True)) if f.base_name.startswith("v=")]
    return sorted(int(v[2:]) for v in found if fs.get_file_info(f"{path}/{v}/_SUCCESS").type == FileType.File)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


@dataclass
class File(InputPartition):
    path: str


class Guarded(DataSource):
    """Options: path; at_least, the rows without which a write is refused (1); keep, the versions that stay (2)."""

    @classmethod
    def name(cls) -> str:
        return "guarded"

    def _newest(self):
        fs, path = _open(self.options["path"])
        found = _versions(fs, path)
        if not found:
            raise FileNotFoundError(f"nothing is published at {path}")
        return fs, f"{path}/v={found[-1]}"

    def _files(self) -> list[str]:
        from pyarrow.fs import FileSelector

        fs, folder = self._newest()
        return sorted(f.path for f in fs.get_file_info(FileSelector(folder)) if f.base_name.endswith(".parquet"))

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        fs, _ = _open(self.options["path"])
        with fs.open_input_file(self._files()[0]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def reader(self, schema):
        return Reader(self.options["path"], self._files())

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], int(self.options.get("at_least", 1)), int(self.options.get("keep", 2)))


class Reader(DataSourceReader):
    def __init__(self, path: str, files: list[str]):
        self.path, self.files = path, files

    def partitions(self):
        return [File(f) for f in self.files]

    def read(self, partition):
        import pyarrow.parquet as pq

        fs, _ = _open(self.path)
        with fs.open_input_file(partition.path) as f:
            yield from pq.ParquetFile(f).iter_batches()


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, at_least: int, keep: int):
        self.path, self.at_least, self.keep = path, at_least, keep
        self.folder = f"_{uuid.uuid4().hex[:12]}.tmp"

    def write(self, iterator):
        """One file for each task; none if it has no row."""
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        fs, path = _open(self.path)
        out, rows, name = None, 0, None
        try:
            for batch in iterator:
                if out is None:
                    # another name for each attempt
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.parquet"
                    fs.create_dir(f"{path}/{self.folder}")
                    sink = fs.open_output_stream(f"{path}/{self.folder}/{name}")
                    out = pq.ParquetWriter(sink, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
                sink.close()
        return Written(name, rows)

    def commit(self, messages):
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, path = _open(self.path)
        folder = f"{path}/{self.folder}"
        told = {m.file: m.rows for m in messages if m is not None and m.file}
        if None in messages:
            raise OSError("a task has sent no message")
        if sum(told.values()) < self.at_least:
            raise ValueError(f"{sum(told.values())} rows were written; the table needs {self.at_least}")
        fs.create_dir(folder)
        for f in fs.get_file_info(FileSelector(folder)):
            if f.base_name not in told:
                fs.delete_file(f.path)
        for name, rows in told.items():
            with fs.open_input_file(f"{folder}/{name}") as f:
                if (found := pq.read_metadata(f).num_rows) != rows:
                    raise OSError(f"{name} has {found} rows; its task wrote {rows}")
        fs.open_output_stream(f"{folder}/_SUCCESS").close()
        before = _versions(fs, path)
        fs.move(folder, f"{path}/v={before[-1] + 1 if before else 0}")
        for n in before[: -(self.keep - 1) or None]:
            fs.delete_dir(f"{path}/v={n}")

    def abort(self, messages):
        from pyarrow.fs import FileType

        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}/{self.folder}").type == FileType.Directory:
            fs.delete_dir(f"{path}/{self.folder}")
