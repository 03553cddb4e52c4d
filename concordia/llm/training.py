"""Labelled rows for the classifiers, and running a fit in one task.

A fit reads at most ``SAMPLE_ROWS`` labelled documents, those of smallest id
hash, and never a row whose crc32(id as text) mod 5 is 0 (the held-out rows).
The bound is a parameter; scoring always covers every document.

Defined cases: a labelled row without a document, or a document without a
label, is not a training row; a document labelled twice counts with its larger
label; a null label or id is none; rows of equal id are training rows each; an
empty table of either kind gives no model.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .kernel import tidy

SAMPLE_ROWS = 8192
HELD_OUT_MOD = 5


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD


def labelled(docs: DataFrame, labels: DataFrame, label: str | dict[str, Column], rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y, fold) of the training sample; with a dict, one column of 0, 1 or null for each name instead of y."""
    wanted = {"y": F.col(label)} if isinstance(label, str) else label
    last = list(wanted)[-1]
    known = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *[c.cast("int").alias(n) for n, c in wanted.items()]).where(F.col(last).isNotNull())
    one = known.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in wanted])
    one = one.withColumn("fold", fold_of(F.col("doc_id")).cast("int")).where("fold <> 0")
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(raw))) as z:
        return {k: z[k] for k in z.files}


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Run fit on the whole (bounded) sample in one task; its arrays come back to the driver."""

    ship(sample.sparkSession)

    def task(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            table = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            yield pa.record_batch([pa.array([_packed(fit(table))], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(tidy(task), "model binary").collect()
    return _unpacked(rows[0]["model"]) if rows else {}


def each_in_a_task(spark: SparkSession, n: int, work: Callable[[int], dict[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """work(0), ..., work(n - 1), each in a task of its own."""

    ship(spark)

    def task(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([_packed(work(i))], pa.binary())], ["id", "got"])

    rows = spark.range(0, n, 1, n).mapInArrow(tidy(task), "id bigint, got binary").collect()
    return [_unpacked(r["got"]) for r in sorted(rows, key=lambda r: r["id"])]


def share(df: DataFrame, model):
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(model)
