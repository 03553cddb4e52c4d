"""Premises: which decided slots still stand on what they were concluded from, and how far they can be trusted.

``routes`` are alternatives, each a conjunction of premise keys
(array<array<string>>).  A slot is in when it is asserted and has no routes,
or some route's premises are all in: the least fixed point, so a cycle without
an outside ground is out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import cut


ROUTES = "array<array<string>>"


def conjunction(premises: Column) -> Column:
    """A flat list of premises is one route; empty names go, an empty list is none."""
    clean = F.filter(F.coalesce(premises, F.array().cast("array<string>")), lambda p: p.isNotNull() & (F.length(p) > 0))
    return F.when(F.size(clean) > 0, F.array(clean)).otherwise(F.array().cast(ROUTES))


def routes_of(premises: Column) -> Column:
    """Premises as a model gives them (array<string>, a nested list as its JSON) to routes.

    A flat list is one conjunction; where any member is a list, the members are
    alternatives and a bare name among them is a route of one premise.
    """
    given = F.coalesce(premises, F.array().cast("array<string>"))
    nested = lambda p: F.coalesce(F.startswith(F.ltrim(p), F.lit("[")), F.lit(False))
    each = F.transform(given, lambda p: conjunction(F.when(nested(p), F.from_json(p, "array<string>")).otherwise(F.array(p))))
    return F.when(F.exists(given, nested), F.flatten(each)).otherwise(conjunction(given))


def distinct_routes(routes: Column) -> Column:
    """Routes without repeats: two that name the same premises are one, the first form stays."""
    marked = F.transform(routes, lambda r, i: F.struct(F.array_sort(r).alias("sig"), i.alias("i"), r.alias("route")))
    kept = F.filter(marked, lambda x: ~F.exists(marked, lambda y: (y["sig"] == x["sig"]) & (y["i"] < x["i"])))
    return F.transform(kept, lambda x: x["route"])


def asserted(outcome: Column, resolution: Column | None = None) -> Column:
    """Settled by evidence, or by an adjudication that chose, kept both or set a condition."""
    by_evidence = F.coalesce(outcome == "resolved", F.lit(False))
    return by_evidence if resolution is None else by_evidence | F.coalesce(resolution.isin("choose", "both", "conditional"), F.lit(False))


def in_set(slots: Column) -> Column:
    """Keys that are in, of an array of (key, asserted, routes): one expression, for groups that fit a row.

    Each round admits every slot whose route holds and the array shrinks to
    those still out, so the work is the number of rounds times what is left.
    """
    none = F.array().cast("array<string>")

    def admits(s: Column, known: Column) -> Column:
        return s["asserted"] & ((F.size(s["routes"]) == 0) | F.exists(s["routes"], lambda r: F.forall(r, lambda p: F.array_contains(known, p))))

    def step(acc: Column, _: Column) -> Column:
        new = F.transform(F.filter(acc["out"], lambda s: admits(s, acc["known"])), lambda s: s["key"])
        merged = F.element_at(F.transform(F.array(new), lambda n: F.struct(F.concat(acc["known"], n).alias("known"), F.filter(acc["out"], lambda s: ~F.array_contains(n, s["key"])).alias("out"), (F.size(n) == 0).alias("done"))), 1)
        return F.when(acc["done"], acc).otherwise(merged)

    start = F.struct(none.alias("known"), slots.alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(slots))), start, step)["known"]


def admitted(slots: DataFrame, groups: list[str], group_limit: int = 4096) -> DataFrame:
    """(groups, key) of the slots that are in. slots: groups, key, asserted, routes.

    Groups of up to group_limit slots are one row each; larger ones go through
    rounds of joins, where a group's size does not matter.
    """
    sizes = slots.groupBy(*groups).agg(F.count("*").alias("_n"))
    tagged = slots.join(sizes, groups)
    small = tagged.where(F.col("_n") <= group_limit)
    each = small.groupBy(*groups).agg(F.collect_list(F.struct("key", "asserted", "routes")).alias("s"))
    found = each.select(*groups, F.explode(in_set(F.col("s"))).alias("key"))
    large = tagged.where(F.col("_n") > group_limit).drop("_n")
    if large.isEmpty():
        return found
    return found.unionByName(admitted_by_joins(large, groups))


def admitted_by_joins(slots: DataFrame, groups: list[str]) -> DataFrame:
    """The same fixed point by rounds of joins, each materialised, until a round admits none."""
    on = [*groups, "key"]
    known = cut(slots.where("asserted and size(routes) = 0").select(*on))
    edges = cut(slots.where("asserted and size(routes) > 0").select(*on, F.posexplode("routes").alias("route", "premises")).select(*on, "route", F.explode(F.array_distinct("premises")).alias("premise")))
    need = edges.groupBy(*on, "route").agg(F.count("*").alias("need"))
    while True:
        met = edges.join(known.withColumnRenamed("key", "premise"), [*groups, "premise"]).groupBy(*on, "route").agg(F.count("*").alias("met"))
        ready = need.join(met, [*on, "route"]).where("need = met").select(*on).distinct()
        new = cut(ready.join(known, on, "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


def derive(slots: DataFrame, groups: list[str]) -> DataFrame:
    """slots with status (axiom, founded, retracted, unasserted), satisfied_by and unmet (sorted).

    Premises meet the keys that are in by a join, so a group's size does not
    matter here either.  A route without premises holds.
    """
    on = [*groups, "key"]
    known = admitted(slots, groups).select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("key").alias("_known"))
    routed = slots.where(F.size("routes") > 0).select(*on, F.posexplode("routes").alias("at", "route"))
    named = routed.select(*on, "at", "route", F.explode_outer(F.array_distinct("route")).alias("premise"))
    met = named.join(known, [*[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups], F.col("premise") == F.col("_known")], "left")
    lacks = F.when(F.col("premise").isNotNull() & F.col("_known").isNull(), F.col("premise"))
    per = met.groupBy(*on, "at").agg(F.first("route").alias("route"), F.collect_set(lacks).alias("lacks"))
    first = F.min(F.when(F.size("lacks") == 0, F.struct("at", "route")))
    judged = per.groupBy(*on).agg(first.alias("_holds"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lacks")))).alias("_lacks"))
    rows = slots.join(judged, on, "left")
    none = F.size("routes") == 0
    status = F.when(none & F.col("asserted"), "axiom").when(none, "unasserted").when(F.col("_holds").isNotNull(), "founded").otherwise("retracted")
    unmet = F.when(status == "retracted", F.col("_lacks")).otherwise(F.array().cast("array<string>"))
    return rows.select(*slots.columns, status.alias("status"), F.col("_holds.route").alias("satisfied_by"), unmet.alias("unmet"))


def counters(derived: DataFrame, groups: list[str]) -> DataFrame:
    """Per group: slots in, retracted, and with premises."""
    return derived.groupBy(*groups).agg(
        F.count_if(F.col("status").isin("axiom", "founded")).alias("in_count"), F.count_if(F.col("status") == "retracted").alias("retracted_count"), F.count_if(F.size("routes") > 0).alias("derived_count")
    )


def unknown_premises(slots: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct premises that name no slot of their group."""
    named = slots.select(*groups, F.explode(F.flatten("routes")).alias("premise")).distinct()
    return named.join(slots.select(*groups, F.col("key").alias("premise")), [*groups, "premise"], "left_anti")


def slot_trust(claims: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, trust): the best trust among claims of the values shown; 0 without any. shown: keys, values array."""
    support = claims.join(shown.select(*keys, F.explode("values").alias("value")), [*keys, "value"])
    per = support.groupBy(*keys).agg(F.max(F.coalesce("trust", F.lit(0))).alias("trust"))
    return shown.select(*keys).join(per, keys, "left").select(*keys, F.coalesce("trust", F.lit(0)).alias("trust"))


def trust_ceiling(slots: DataFrame, trust: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, key, ceiling): of each slot with routes the best route's weakest premise; an unknown premise is 0."""
    edges = slots.select(*groups, "key", F.posexplode("routes").alias("route", "premises")).select(*groups, "key", "route", F.explode("premises").alias("premise"))
    met = edges.join(trust.select(*groups, F.col("key").alias("premise"), F.col("trust").alias("_t")), [*groups, "premise"], "left")
    return met.groupBy(*groups, "key", "route").agg(F.min(F.coalesce("_t", F.lit(0))).alias("_low")).groupBy(*groups, "key").agg(F.max("_low").alias("ceiling"))


def trust_violations(claims: DataFrame, slots: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, key, rule) of every broken rule. slots: groups, key, values (those shown), routes.

    ``unsupported``: what is shown has no claim; ``unlabelled``: a supporting
    claim has no trust; ``derivation-ceiling``: shown trust is above the
    ceiling.  (Shown trust is by construction the best supporter's, so rules
    that compare the two cannot break.)
    """
    keys = [*groups, "key"]
    showing = slots.where(F.size("values") > 0)
    support = showing.select(*keys, F.explode("values").alias("value")).join(claims.select(*keys, "value", "trust"), [*keys, "value"])
    per = support.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col("trust").isNull()).alias("_bare"))
    judged = showing.join(per, keys, "left")
    unsupported = judged.where("_n is null").select(*keys, F.lit("unsupported").alias("rule"))
    unlabelled = judged.where("_bare > 0").select(*keys, F.lit("unlabelled").alias("rule"))
    trust = slot_trust(claims, slots, keys)
    above = trust_ceiling(slots, trust, groups).join(trust, keys).join(judged.where("_n > 0").select(*keys), keys).where("trust > ceiling")
    return unsupported.unionByName(unlabelled).unionByName(above.select(*keys, F.lit("derivation-ceiling").alias("rule")))
