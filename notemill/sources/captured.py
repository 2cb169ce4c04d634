"""Captured pages as a Python data source: `spark.read.format("captured_pages").load(folder)` reads a folder of Parquet files
or of `.html` files. Fetching, rendering and pacing belong to the capture, not to the engine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page_id bigint, url string, html string"


@dataclass
class _Part(InputPartition):
    path: str
    group: int
    first: int = 0


class CapturedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        """One for each row group of Parquet, one for each page of HTML."""
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        info = fs.get_file_info(root)
        files = [root] if info.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file)
        out: list[InputPartition] = []
        for f in files:
            if f.endswith(".parquet"):
                out += [_Part(f, g) for g in range(pq.ParquetFile(f, filesystem=fs).num_row_groups)]
            elif f.endswith((".html", ".htm")):
                out.append(_Part(f, -1, len(out)))
        return out

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        if part.group < 0:
            with fs.open_input_stream(part.path) as f:
                html = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_pydict({"page_id": pa.array([part.first], pa.int64()), "url": ["file://" + part.path], "html": [html]})
            return
        table = pq.ParquetFile(part.path, filesystem=fs).read_row_group(part.group, columns=["page_id", "url", "html"])
        yield from table.to_batches(max_chunksize=1000)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapturedPages)
