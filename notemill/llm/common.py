"""What several operators of this subpackage share: tables in the cluster's shared folder and Arrow batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.session import shared_dir

#: Documents that a kernel handles at once, and the bytes of Arrow data that they may hold together.
BATCH_ROWS = 250
BLOCK_BYTES = 2_000_000
#: Bytes of a table's files up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notemill-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._notemill_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._notemill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, of: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if the files of the staged table that it is, or is read from (of), hold few bytes; else the
    same join shuffles."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path((of or df)._notemill_path)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if found <= most else df


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most that many rows, fewer where rows are large; no part is copied."""
    step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """Applies function to parts of a few rows of each Arrow batch of df (Spark bounds a batch by bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                if (out := function(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
