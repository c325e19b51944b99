"""Tables that a job writes in between, so that they are computed once and a lost executor costs a stage."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a written side is broadcast.
BROADCAST_BYTES = 16 << 20
#: Keys that hold more than one in HOT_KEYS of the rows: there are at most so many.
HOT_KEYS = 1000


def kept(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the folder in spark.checkpoint.dir; unset, as in tests, to a temporary one, in local mode only.

    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="ringproof-")
    path = f"{at.rstrip('/')}/ringproof/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a written table have at most `most` bytes: 8 a column and those of its strings."""
    row = F.lit(8 * len(df.columns)) + sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    return (df.agg(F.sum(row)).first()[0] or 0) <= most


def join_bounded(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcasts right, a written table, if it is bounded; shuffles both sides beyond."""
    return left.join(F.broadcast(right) if bounded(right, most) else right, on, how)


def salted(left: DataFrame, right: DataFrame, on: list[str], by: Column, salts: int = 32, share: int = HOT_KEYS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt, and the columns to join them on. A key with over one in `share` of left's rows has `salts` of them on the right; others have one.

    The hot keys are fewer than `share`, so they are broadcast. by: what deals the rows of a hot key. left is read twice."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = left.count()
    hot = F.broadcast(counts.where(F.col("_n") * share > total).select(*on, F.lit(True).alias("_hot")))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt, right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot"), [*on, "_salt"]
