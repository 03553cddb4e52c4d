"""Bloom filters of 64-bit keys as a broadcast table of bitmaps, with DataFrame functions only.

The bit space has two halves, one a hash function, in buckets of ``BUCKET``
bits.  It has ``SLOTS_PER_KEY`` slots a key in each half, but never more than
``filter_bytes`` allows, so the broadcast is bounded whatever the input: with
more keys than that the share of false alarms grows, (1 - exp(-keys / slots))
squared, and nothing else changes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BROADCAST_BYTES, fresh

SLOTS_PER_KEY = 16
BUCKET = 32768  # bits of one bitmap
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(setting: str) -> int:
    m = re.match(r"(\d+)([bkmgt]?)", setting.strip().lower())
    return int(m[1]) * _UNITS[m[2]] if m else 0


def filter_bytes(spark: SparkSession) -> int:
    """A sixteenth of an executor's or the driver's memory, the smaller; 64 MB at least, 2 GB at most."""
    heap = min(_bytes(spark.conf.get(f"spark.{who}.memory", "1g")) for who in ("executor", "driver"))
    return min(max(heap // 16, BROADCAST_BYTES), 2 << 30)


def slots_for(spark: SparkSession, n_keys: int) -> int:
    """Slots of each half of the filter, a whole number of buckets."""
    most = filter_bytes(spark) * 8 // 2 // BUCKET
    return max(1, min(-(-n_keys * SLOTS_PER_KEY // BUCKET), most)) * BUCKET


def slots(key: Column, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(m)) + F.lit(k * m) for k in (0, 1)]


def build(keys: DataFrame, key: Column, m: int, least: int) -> DataFrame:
    """(bucket, bits) of the slots that ``least`` rows or more fall on; combined before the shuffle."""
    met = keys.select(F.explode(F.array(*slots(key, m))).alias("slot")).groupBy("slot").count().where(F.col("count") >= least)
    return met.groupBy((F.col("slot") / BUCKET).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % BUCKET).alias("bits"))


def tested(rows: DataFrame, key: Column, bits: DataFrame, m: int, into: str) -> DataFrame:
    """rows with a boolean column ``into``, False only for a key that is surely not in the filter. No row moves."""
    held = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
    hits = []
    for k, slot in enumerate(slots(key, m)):
        at, place, bucket, bitmap, hit = fresh(rows, f"slot{k}", f"place{k}", f"bucket{k}", f"bits{k}", f"hit{k}")
        part = bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(bitmap))
        rows = rows.withColumn(at, slot).withColumn(place, (F.col(at) / BUCKET).cast("long"))
        rows = rows.join(F.broadcast(part), F.col(place) == F.col(bucket), "left")
        byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({at} % {BUCKET} div 8 + 1 as int), 1)")), 16, 10).cast("int")
        rows = rows.withColumn(hit, F.coalesce(F.getbit(byte, (F.col(at) % 8).cast("int")), F.lit(0)) == 1).drop(at, place, bucket, bitmap)
        hits.append(F.col(hit))
    return rows.select(*held, (hits[0] & hits[1]).alias(into))
