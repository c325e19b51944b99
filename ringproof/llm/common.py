"""Shared helpers: table access, shared scratch tables, Arrow mapping, size-checked joins."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: The separators between words: space and the five controls from tab to carriage return.
#: bytes.split() without an argument splits at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side is broadcast by join_sized; above it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes up to which a side is broadcast by join_bounded.
BROADCAST_BYTES = 16 << 20
#: Keys that join_hot takes apart at most.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset, as in tests, a temporary one is taken, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ringproof-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one job in the shared folder. Each cuts the lineage and survives lost executors.

    Tables go when dropped, or when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/ringproof/{job}-{uuid.uuid4().hex}"
        self.schemas: dict = {}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.at))

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.at}/{name}")
        self.schemas[name] = df.schema  # an empty table may leave no file to tell it
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.at}/{name}"), True)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, slice_bytes: int = 8 << 20) -> DataFrame:
    """make() is called once a task and gives a function from the columns of a batch to the columns of the output (lists or arrays)."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        func = make()
        for batch in batches:
            for part in _slices(batch, slice_bytes):
                out = func({n: part.column(n).to_pylist() for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in ((out[f.name], f) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def _slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of about 8 MB, or `most`, so that a batch of long texts doesn't become one huge list."""
    n = max(1, min(batch.num_rows, batch.nbytes // most + 1))
    step = -(-batch.num_rows // n) if batch.num_rows else 1
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts right if it has at most `most` rows (counted first: right should be a written table); shuffles both sides beyond."""
    return left.join(F.broadcast(right) if right.count() <= most else right, on, how)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df, a written table, have at most `most` bytes: 8 a column and those of its strings."""
    row = F.lit(8 * len(df.columns)) + sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")), F.lit(0))
    return (df.agg(F.sum(row)).first()[0] or 0) <= most


def join_bounded(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts right, a written table, if it is bounded; shuffles both sides beyond."""
    return left.join(F.broadcast(right) if bounded(right, most) else right, on, how)


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "left", n: str = "_n") -> DataFrame:
    """left joined to right (one row a key, a written table); right[n] is how many rows of left have the key, and goes.

    Keys with over one in HOT_KEYS of all those rows are at most HOT_KEYS, a proven bound: their rows are joined by a
    broadcast and never meet in a task. The others are shuffled. how: left or inner. left is read twice: a written table."""
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(n) * HOT_KEYS > total).drop(n))
    cold = right.where(F.col(n) * HOT_KEYS <= total).drop(n)
    return left.join(hot, on).unionByName(left.join(F.broadcast(right.where(F.col(n) * HOT_KEYS > total).select(on)), on, "left_anti").join(cold, on, how))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
