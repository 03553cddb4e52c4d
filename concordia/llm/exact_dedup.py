"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 turns each text into a digest and two slots of a bit space that grows
with the number of rows, counts the slots (combined before the shuffle: a
group of copies that holds a third of all rows is one row a task) and packs
the slots seen twice or more into 4 KB bitmaps.  Those bitmaps are the Bloom
filter of *possibly repeated* hashes, broadcast at a bounded size
(``bloom.filter_bytes``) whatever the input.  Pass 2 tests each row against
it: a row whose two bits are not both set is certainly alone and passes
straight through; the others, copies and false alarms, are the only ones that
shuffle, by digest.  Where the bound leaves fewer slots than rows call for,
more false alarms shuffle; rows that miss never do.

(A task's two bitmaps of what it saw once and twice are sparse, a few bits in
each 4 KB, so what moves in pass 1 is the numbers of their set bits.)

Defined cases: a null text counts as empty, and empty texts are equal to each
other; a null id counts as larger than any other; of rows equal in text and
id one stays; a table without rows gives no rows; a text of any length is one
row whose digest alone goes on (op9) or which shuffles whole only if its
digest may be repeated (drop_copies); columns of any other name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .store import WHITE, cut, fresh, meet, quoted


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def repeat_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Pass 1: (bucket, bits) of slots that two rows or more fall on, and the slots of one function."""
    m = bloom.slots_for(keys.sparkSession, keys.count())
    return cut(bloom.build(keys, F.col(key), m, least=2)), m


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256."""
    d = cut(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
    n = d.count()
    seen = bloom.tested(d, F.col("text_sha256"), *repeat_filter(d, "text_sha256"), "again")
    alone = seen.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = seen.where("again").drop("again")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")
    groups = cut(again.groupBy("text_sha256").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")))
    back = meet(again, groups, "text_sha256", "group_size", n)
    return alone.unionByName(back.select("doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without later copies, all columns kept.

    Rows that are surely alone never shuffle.  Of each group the smallest row
    by (id, then the other columns) is chosen in a combining aggregation, so a
    large group is one row a task before it moves.
    """
    sha, again = fresh(docs, "sha", "again")
    names = quoted(docs.columns)
    keyed = docs.withColumn(sha, digest(F.col(text_col)))
    seen = bloom.tested(keyed, F.col(sha), *repeat_filter(cut(keyed.select(sha)), sha), again)
    alone = seen.where(~F.col(again)).select(*names)
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.struct(*names).alias("row"))
    kept = seen.where(F.col(again)).groupBy(sha).agg(F.min(row).alias("least")).select("least.row.*")
    return alone.unionByName(kept)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
