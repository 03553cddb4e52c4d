"""Slots: opinions grouped by key, kept as sets of triples and decided by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E


def items(opinions: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, value, source, evidence): the slot states in table form."""
    return opinions.select(*keys, "value", "source", "evidence").distinct()


def scores(state: DataFrame, keys: list[str], score: str = "egalitarian") -> DataFrame:
    """One row for each key and value with its score and number of items."""
    if score == "egalitarian":
        rule: Column = F.array(F.sum(E.weight(F.col("evidence"))).cast("long"))
    else:
        rule = F.sort_array(F.collect_list("evidence"), asc=False)
    return state.groupBy(*keys, "value").agg(rule.alias("score"), F.count("*").alias("n_items"), F.max("evidence").alias("max_evidence"))


def decide(state: DataFrame, keys: list[str], score: str = "egalitarian") -> DataFrame:
    """One row for each key: outcome, winner, tied (sorted array), n_items.

    The best score of a key and the decision share one partitioning by key;
    items are combined by (key, value) before that shuffle.
    """
    w = Window.partitionBy(*keys)
    per = scores(state, keys, score).withColumn("_best", F.max("score").over(w)).withColumn("_n", F.sum("n_items").over(w))
    best = per.where(F.col("score") == F.col("_best")).groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("_v"), F.first("_n").cast("long").alias("n_items"))
    return best.select(*keys, E.decision_of(F.col("_v")).alias("d"), "n_items").select(*keys, "d.*", "n_items")


def states(opinions: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key with its canonical state: distinct triples sorted by value, source, level."""
    item = F.struct(F.col("value"), F.col("source"), F.col("evidence").cast("int").alias("evidence"))
    return opinions.groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("state"))


def presented(outcome: Column, winner: Column, tied: Column, resolution: Column | None = None, chosen: Column | None = None) -> Column:
    """The values a slot shows: its winner, an adjudicated choice, or what is tied."""
    out = F.when(outcome == "resolved", F.array(winner))
    if resolution is not None:
        out = out.when(resolution == "choose", F.array(chosen))
    return out.when(outcome == "disputed", tied).otherwise(F.array().cast("array<string>"))


def best_texts(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The text that stands for each value: highest level, then longest, then smallest."""
    from ..functions.text import utf16_length

    rank = F.row_number().over(Window.partitionBy(*keys, "value").orderBy(F.col("evidence").desc(), utf16_length(F.col("text")).desc(), "text"))
    return claims.withColumn("_r", rank).where("_r = 1").select(*keys, "value", "text")


def top_quotes(claims: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The first n claims of each value by level, then by order of arrival."""
    rank = F.row_number().over(Window.partitionBy(*keys, "value").orderBy(F.col("evidence").desc(), "claim_ord"))
    return claims.withColumn("quote_rank", rank).where(F.col("quote_rank") <= n)


def conflicts(opinions: DataFrame, decided: DataFrame, keys: list[str], cap: int = 12, group: list[str] | None = None) -> DataFrame:
    """Disputed slots, the most corroborated first, at most ``cap`` of each group: n_options, n_sources, rank."""
    tied = decided.where("outcome = 'disputed'").select(*keys, F.explode("tied").alias("value"))
    per = tied.join(opinions.select(*keys, "value", "source"), [*keys, "value"]).groupBy(*keys, "value").agg(F.countDistinct("source").alias("n"))
    found = per.groupBy(*keys).agg(F.count("*").alias("n_options"), F.sum("n").cast("long").alias("n_sources"))
    order = [F.col("n_sources").desc(), *[F.col(k) for k in keys if k not in (group or [])]]
    if not group:  # the best of each task, then of those: no task sorts all
        return found.orderBy(*order).limit(cap).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= cap)
