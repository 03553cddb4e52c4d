"""Where intermediate tables go, and small helpers of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space, and a word, as Java regular expressions.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only when its checked size is at most this.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local master may do without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; what follows does not depend on any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, n_bytes: float) -> DataFrame:
    """Broadcast df if it is proven small, else leave the join to a shuffle."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names for columns of our own beside those of df, none of which they equal."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        k, name = 0, f"_{base}"
        while name in taken:
            k, name = k + 1, f"_{base}{k}"
        taken.add(name)
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Keys with over 1 / HEAVY of all rows are at most HEAVY, so their rows are broadcast whatever the input.
HEAVY = 32768


def meet(rows: DataFrame, per_key: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """rows joined with per_key, one row a key (materialised), where a key may hold a third of all rows.

    Keys of large ``weight`` (their number of rows) are broadcast, so no task
    gathers such a key; the others meet by shuffle.  Inner join, ``weight`` kept.
    """
    large = F.col(weight) > n_rows // HEAVY
    other = [c for c in per_key.columns if c != key]
    heavy = per_key.where(large).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in other])
    met = rows.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left")
    hot = met.where("_key is not null").select(*rows.columns, *[F.col(f"_{c}").alias(c) for c in other])
    cold = met.where("_key is null").select(*rows.columns).join(per_key.where(~large), key)
    return hot.unionByName(cold.select(*hot.columns))


def rewritten(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
