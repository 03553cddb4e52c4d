"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target is its share of all words by weight, capped at three times
its own words, the excess shared again by weight (a water level, found in one
pass over the sources sorted by cap for each unit of weight).  A document is
wanted target / source size times, a whole number of copies and a fraction.
The fractions of a source are rounded jointly: two documents meet, and word
mass moves from one to the other, at random and without bias, until one of the
two fractions becomes 0 or 1; the other goes on to meet the next.  Mass is
conserved at every meeting, so what a source takes ends within one document
of its target, while each document keeps its own expected number of copies.

The largest documents of a source (over 1 / ``HEAD`` of its words, so at most
``HEAD`` of them) come first, and each meets the pool of all smaller ones as if
that were one document: the pool's common fraction moves by what the large one
gains or gives.  The rest meet in pairs, in a tree: documents are dealt by hash into chunks of about
``CHUNK`` within their source, each chunk is folded by an ``aggregate`` over
its array sorted by size, the large first (so that small ones meet last and
little is left open), and leaves one undecided document; the chunks' residuals
are dealt and folded again until a source has one.  A source that holds a
third of all rows is only more chunks.  Chance comes from hashes of the id and
the level, so reruns agree.

Whoever is undecided last in a source, with nothing left to meet, is rounded
alone by its fraction, so a source's words end within that one document of
its target.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken 0 words; an empty table gives no
rows; equal or null ids, and repeated rows, are separate documents; a text of
any length is its number of words.  ``mix`` keeps all columns, whatever their
names; of rows equal in source, id and text it takes as many copies in all as
the rounding gave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, fresh, n_words, quoted, sized_broadcast, uniform

WEIGHTS = (5, 2, 1)
CAP = 3
CHUNK = 128
HEAD = 1024
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from rows of (source, size); one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    line = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rest = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest))
    level = F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(everything)
    return per.select("source", "source_size", "n_docs", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def _meet(acc: Column, e: Column) -> Column:
    """One meeting of the undecided document of acc with e; w: words, x: fraction, u: chance."""
    p = acc["open"]
    w1, x1, w2, x2 = p["w"], p["x"], e["w"], e["x"]
    gain1, give2 = (1 - x1) * w1, x2 * w2  # mass that may move into the first
    give1, gain2 = x1 * w1, (1 - x2) * w2  # and out of it
    into, out = F.least(gain1, give2), F.least(give1, gain2)
    up = e["u"] * (into + out) < out
    y1 = F.when(up, F.when(gain1 <= give2, 1.0).otherwise(x1 + into / w1)).otherwise(F.when(give1 <= gain2, 0.0).otherwise(x1 - out / w1))
    y2 = F.when(up, F.when(give2 <= gain1, 0.0).otherwise(x2 - into / w2)).otherwise(F.when(gain2 <= give1, 1.0).otherwise(x2 + out / w2))
    first_done = F.when(up, gain1 <= give2).otherwise(give1 <= gain2)

    def unit(a: Column, x: Column) -> Column:
        return F.struct(a["o"].alias("o"), a["key"].alias("key"), a["row"].alias("row"), a["w"].alias("w"), x.alias("x"), a["u"].alias("u"))

    met = F.struct(unit(p, y1).alias("a"), unit(e, y2).alias("b"), first_done.alias("done"))
    named = F.element_at(F.transform(F.array(met), lambda m: F.struct(
        F.when(m["done"], m["b"]).otherwise(m["a"]).alias("open"),
        F.array_append(acc["closed"], F.when(m["done"], m["a"]).otherwise(m["b"])).alias("closed"),
    )), 1)
    return F.when(p.isNull(), F.struct(e.alias("open"), acc["closed"].alias("closed"))).otherwise(named)


def round_copies(units: DataFrame, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """Round fractions jointly within each source.

    units: (source, n_docs, key, row struct, w double > 0, x double in (0, 1)).
    Returns (source, row, x) with every x 0 or 1; every unit appears once.
    """
    kind = "array<" + units.select(F.struct((-F.col("w")).alias("o"), "key", "row", "w", "x", F.lit(0.0).alias("u")).alias("s")).schema["s"].dataType.simpleString() + ">"
    one = kind[6:-1]
    done, level = None, 0
    current = units.withColumn("_chunks", F.ceil(F.col("n_docs") / chunk))
    while True:
        dealt = current.withColumn("_chunk", F.pmod(F.xxhash64(F.col("key"), F.lit(level), F.lit(seed)), F.col("_chunks")))
        member = F.struct((-F.col("w")).alias("o"), "key", "row", "w", "x", uniform(F.col("key"), F.lit(level), seed=seed + 1).alias("u"))
        groups = dealt.groupBy("source", "_chunk").agg(F.sort_array(F.collect_list(member)).alias("m"), F.first("_chunks").alias("_chunks"))
        start = F.struct(F.lit(None).cast(one).alias("open"), F.array().cast(kind).alias("closed"))
        folded = cut(groups.select("source", "_chunks", F.aggregate("m", start, _meet).alias("f")))
        closed = folded.select("source", F.explode("f.closed").alias("c")).select("source", "c.row", "c.x")
        left = folded.select("source", "_chunks", "f.open")
        whole = left.where("open.x in (0.0, 1.0) or _chunks = 1")
        last = F.when(F.col("open.x").isin(0.0, 1.0), F.col("open.x")).otherwise((uniform(F.col("open.key"), F.lit(-1), seed=seed + 1) < F.col("open.x")).cast("double"))
        part = closed.unionByName(whole.select("source", "open.row", last.alias("x")))
        done = part if done is None else done.unionByName(part)
        rest = left.where("open.x not in (0.0, 1.0) and _chunks > 1")
        if rest.isEmpty():
            return done
        level += 1
        current = rest.select("source", F.ceil(F.col("_chunks") / chunk).alias("_chunks"), "open.key", "open.row", "open.w", "open.x")


def _meet_pool(acc: Column, e: Column) -> Column:
    """A large document e meets the pool: acc.mass of acc.words is still wanted, from e and all smaller ones."""
    w, x = e["w"], acc["mass"] / acc["words"]
    pool = acc["words"] - w
    gain, give = (1 - x) * w, x * w
    held, room = x * pool, (1 - x) * pool
    into, out = F.least(gain, held), F.least(give, room)
    up = e["u"] * (into + out) < out
    y = F.when(up, F.when(gain <= held, 1.0).otherwise(x + into / w)).otherwise(F.when(give <= room, 0.0).otherwise(x - out / w))
    y = F.when(y.isin(0.0, 1.0), y).otherwise((e["v"] < y).cast("double"))
    mass = F.greatest(F.lit(0.0), F.least(pool, F.when(up, held - into).otherwise(held + out)))
    return F.struct(mass.alias("mass"), pool.alias("words"), F.array_append(acc["closed"], F.struct(e["row"].alias("row"), y.alias("x"))).alias("closed"))


def round_heads(heads: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(source, row, x) of large documents, and (source, mass, words) that their meetings leave to the pool."""
    kind = "array<" + heads.select(F.struct("row", "x").alias("s")).schema["s"].dataType.simpleString() + ">"
    u = [uniform(F.col("key"), F.lit(k), seed=seed + 2).alias(n) for k, n in enumerate("uv")]
    groups = heads.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "key", "row", "w", *u))).alias("m"),
        F.first(F.col("x") * F.col("source_size")).alias("mass"), F.first(F.col("source_size").cast("double")).alias("words"),
    )
    start = F.struct("mass", "words", F.array().cast(kind).alias("closed"))
    folded = cut(groups.select("source", F.aggregate("m", start, _meet_pool).alias("f")))
    return folded.select("source", F.explode("f.closed").alias("c")).select("source", "c.row", "c.x"), folded.select("source", "f.mass", "f.words")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, mark): how many copies the mix takes of each row.

    mark: a hash of the text, to tell rows of equal id apart.
    """
    sizes = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark")))
    targets = cut(source_targets(sizes))
    each = sized_broadcast(targets, 200.0 * targets.count())
    rows = sizes.join(each, sizes["source"].eqNullSafe(each["source"])).drop(each["source"])
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_base", F.floor(wanted)).withColumn("_x", wanted - F.floor(wanted))
    rounds = (F.col("size") > 0) & (F.col("_x") > 0)
    names = ["doc_id", "size", "source_size", "target", "mark"]
    plain = rows.where(~rounds).select(*names[:1], "source", *names[1:], F.when(F.col("size") > 0, F.col("_base")).otherwise(0).cast("long").alias("copies"))
    key = F.xxhash64(F.lit(SEED), "doc_id", "mark")
    units = rows.where(rounds).select("source", "n_docs", "source_size", key.alias("key"), F.struct(*names, "_base").alias("row"), F.col("size").cast("double").alias("w"), F.col("_x").alias("x"))
    large = F.col("w") * HEAD > F.col("source_size")
    heads, pools = round_heads(units.where(large))
    pools = sized_broadcast(pools, 200.0 * pools.count())
    small = units.where(~large).join(pools.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    small = small.withColumn("x", F.coalesce(F.col("mass") / F.col("words"), F.col("x"))).drop("mass", "words")
    settled = F.col("x").isin(0.0, 1.0)
    heads = heads.unionByName(small.where(settled).select("source", "row", "x"))
    got = heads.unionByName(round_copies(small.where(~settled).drop("source_size"))).select(F.col("row.doc_id").alias("doc_id"), "source", *[F.col(f"row.{c}").alias(c) for c in names[1:]], (F.col("row._base") + F.col("x")).cast("long").alias("copies"))
    return plain.unionByName(got)


def _shares(alike: DataFrame, total: str, n_alike: str, keys: list[str]) -> DataFrame:
    """alike with ``share``: the total of its key dealt over the key's rows as evenly as whole numbers go.

    Rows are numbered within (key, partition) and the partitions' counts are
    summed, so no task gathers a key that holds a third of all rows.
    """
    part, place, first = "part", "place", "first"
    numbered = alike.withColumn(part, F.spark_partition_id()).withColumn("order", F.monotonically_increasing_id())
    numbered = cut(numbered)
    counts = numbered.groupBy(*keys, part).agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col(part).alias("s_part"), before.alias(first))
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys]
    placed = numbered.withColumn(place, F.row_number().over(Window.partitionBy(*keys, part).orderBy("order")) - 1)
    placed = placed.join(starts, [*same, F.col(part) == F.col("s_part")])
    share = F.floor(F.col(total) / F.col(n_alike)) + F.when(F.col(first) + F.col(place) < F.col(total) % F.col(n_alike), 1).otherwise(0)
    return placed.select("row", share.alias("share"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, all columns kept.

    Rows meet their number of copies by source, id and a hash of the text; the
    copies of rows equal in all three are dealt over them, none lost.
    """
    names = docs.columns
    taken = take(docs, id_col, text_col, source_col).groupBy("source", "doc_id", "mark").agg(F.sum("copies").alias("total"), F.count("*").alias("alike")).where("total > 0")
    t_source, t_id, t_mark, t_total, t_alike, mark, copy = fresh(docs, "source", "id", "mark", "total", "alike", "hash", "copy")
    taken = taken.toDF(t_source, t_id, t_mark, t_total, t_alike)
    same = F.col(source_col).eqNullSafe(F.col(t_source)) & F.col(id_col).eqNullSafe(F.col(t_id)) & (F.col(mark) == F.col(t_mark))
    met = docs.withColumn(mark, F.xxhash64(text_col)).join(taken, same)

    def repeated(rows: DataFrame, n: Column, columns: list[Column]) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*columns)

    out = repeated(met.where(F.col(t_alike) == 1), F.col(t_total), quoted(names))
    if taken.where(F.col(t_alike) > 1).isEmpty():
        return out
    alike = met.where(F.col(t_alike) > 1).select(F.struct(*quoted(names)).alias("row"), *[F.col(c).alias(n) for c, n in ((t_source, "source"), (t_id, "id"), (t_mark, "mark"), (t_total, "total"), (t_alike, "alike"))])
    dealt = _shares(alike, "total", "alike", ["source", "id", "mark"]).where("share > 0")
    return out.unionByName(repeated(dealt, F.col("share"), [F.col("row.*")]))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    got = take(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
