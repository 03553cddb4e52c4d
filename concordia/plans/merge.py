"""The whole merge: messages to a rendered block for each merge group.

Claims are materialised once; everything behind them up to packing is lazy, and
model answers are the only other place where the plan stops.  ``heuristic`` is
the path without a model, ``aligned`` lets a model align the sources, settle
ties and name premises, and leaves a group whose answer is unusable to the
former.  Both give a ``Merged``: what a block is rendered from, and a report of
how each group came about.  ``apply_step`` is what a conversation gets: a group
that breaks a rule of trust is refused whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import derive as D
from ..operators import models as M
from ..operators import pack as P
from ..operators import render as R
from ..operators import slots as O
from .store import cut

KEYS = ["merge_group", "key"]


def decided_slots(claims: DataFrame, score: str = "egalitarian") -> tuple[DataFrame, DataFrame]:
    """(state, slots): triples, and per slot its decision, features, type of its first claim."""
    state = O.items(claims, KEYS)
    slots = P.features(state, claims, O.decide(state, KEYS, score), KEYS)
    kinds = claims.groupBy(*KEYS).agg(F.min_by("slot_type", "claim_ord").alias("slot_type"))
    return state, slots.join(kinds, KEYS).withColumn("slot_type", F.coalesce("slot_type", F.lit("Fact")))


def render_claims(claims: DataFrame, slots: DataFrame, state: DataFrame, redacted: DataFrame | None = None, **options) -> DataFrame:
    lines = cut(R.slot_lines(slots, state, claims, KEYS))  # packed and joined back
    return R.render(lines, redacted=redacted, **options)


def heuristic_claims(blocks: DataFrame, trust: DataFrame | None = None, strategy: str = "exact") -> DataFrame:
    """Claims by sentence from blocks; trust: (source, trust), what is not listed is untrusted."""
    rows = C.claims_of(blocks, strategy).withColumn("slot_type", F.lit(None).cast("string"))
    if trust is None:
        return rows.withColumn("trust", F.lit(0))
    return rows.join(trust.select(F.col("source").alias("_s"), F.col("trust").alias("trust")), F.col("source") == F.col("_s"), "left").drop("_s").withColumn("trust", F.coalesce("trust", F.lit(0)))


@dataclass
class Merged:
    """claims, state (triples), slots (decided, with features and premises), redacted (merge_group, redacted), report (merge_group, mode, ...)."""

    claims: DataFrame
    state: DataFrame
    slots: DataFrame
    redacted: DataFrame
    report: DataFrame

    def render(self, **options) -> DataFrame:
        return render_claims(self.claims, self.slots, self.state, self.redacted, **options)

    def values_shown(self) -> DataFrame:
        """slots with the values that each shows, and its premises."""
        has = set(self.slots.columns)
        shown = O.presented(F.col("outcome"), F.col("winner"), F.col("tied"), *([F.col("resolution"), F.col("chosen")] if "resolution" in has else []))
        routes = F.coalesce("routes", F.array().cast(D.ROUTES)) if "routes" in has else F.array().cast(D.ROUTES)
        return self.slots.select(*KEYS, shown.alias("values"), routes.alias("routes"))


def redacted_counts(blocks: DataFrame) -> DataFrame:
    """(merge_group, redacted): credentials withheld from a group's sources."""
    return blocks.groupBy("merge_group").agg(F.sum("redacted").alias("redacted"))


#: What a report says of each group, and what it says where nothing of the kind happened.
REPORT = {"mode": "heuristic", "adjudication": "none", "conflicts": 0, "settled": 0, "order_sensitive": 0, "in_count": 0, "retracted_count": 0, "derived_count": 0}


def _reported(groups: DataFrame, *parts: DataFrame) -> DataFrame:
    """groups (merge_group) with what parts (merge_group, some columns of REPORT) say, and the rest as usual."""
    out = groups
    for part in parts:
        out = out.join(part, "merge_group", "left")
    said = {k: F.coalesce(F.col(k), F.lit(usual)) if k in out.columns else F.lit(usual) for k, usual in REPORT.items()}
    return out.select("merge_group", *[c.cast("string" if isinstance(REPORT[k], str) else "bigint").alias(k) for k, c in said.items()])


def heuristic(messages: DataFrame, trust: DataFrame | None = None, score: str = "egalitarian", strategy: str = "exact") -> Merged:
    """messages with merge_group, merged by sentence."""
    blocks = cut(C.blocks(messages))  # each text is redacted once
    rows = cut(heuristic_claims(blocks, trust, strategy))
    state, slots = decided_slots(rows, score)
    ties = slots.where("outcome = 'disputed'").groupBy("merge_group").agg(F.count("*").alias("conflicts"), F.lit("skipped").alias("adjudication"))
    standing = slots.groupBy("merge_group").agg(F.count_if(F.col("outcome") == "resolved").alias("in_count"))
    return Merged(rows, state, slots, redacted_counts(blocks), _reported(slots.select("merge_group").distinct(), ties, standing))


def merge_sessions(messages: DataFrame, trust: DataFrame | None = None, score: str = "egalitarian", strategy: str = "exact", **options) -> DataFrame:
    """messages with merge_group to one rendered block each."""
    return heuristic(messages, trust, score, strategy).render(**options)


def settled(slots: DataFrame, claims: DataFrame, model: M.Model, cap: int = 12) -> tuple[DataFrame, DataFrame]:
    """slots with resolution, chosen and guard for ties that the model settles alike in both orders, and a report of the groups asked about.

    adjudication: ``llm``, or ``error`` where the model gave no usable answer.
    """
    asked = O.conflicts(claims, slots, KEYS, cap, ["merge_group"]).select(*KEYS)
    ties = slots.join(asked, KEYS).select(*KEYS, F.explode("tied").alias("value"))
    if ties.isEmpty():
        return slots, slots.where("false").select("merge_group", F.lit("none").alias("adjudication"))
    quotes = O.top_quotes(claims, KEYS).groupBy(*KEYS, "value").agg(F.array_sort(F.collect_list("text")).alias("quotes"))
    options = cut(ties.join(quotes, [*KEYS, "value"], "left").withColumn("quotes", F.coalesce("quotes", F.array().cast("array<string>"))))
    runs = [M.parse_settlements(M.ask(M.settlement_prompts(options, b), model, M.SETTLE_SYSTEM, 2000), options)[0] for b in (False, True)]
    agreed = cut(M.reconcile(*runs, KEYS).select(*KEYS, F.col("outcome").alias("resolution"), F.col("value").alias("chosen"), "guard", "order_sensitive"))
    answers = agreed.groupBy("merge_group").agg(F.count_if(F.col("resolution") != "unresolvable").alias("settled"), F.count_if("order_sensitive").alias("order_sensitive"), F.lit("llm").alias("how"))
    report = options.groupBy("merge_group").agg(F.countDistinct("key").alias("conflicts")).join(answers, "merge_group", "left")
    report = report.select("merge_group", "conflicts", "settled", "order_sensitive", F.coalesce("how", F.lit("error")).alias("adjudication"))
    return slots.join(agreed.drop("order_sensitive"), KEYS, "left"), report


def aligned(messages: DataFrame, model: M.Model, trust: DataFrame | None = None, score: str = "egalitarian", adjudicate: bool = True, max_slots: int = 40, max_chars: int = 6000) -> Merged:
    """messages with merge_group as a model aligns them; groups without a usable answer are left out."""
    sources = messages.select("merge_group", F.col("session_id").alias("source")).distinct()
    flat = C.flatten(messages, max_chars).join(sources.withColumnRenamed("source", "session_id"), "session_id")
    answers = M.ask(M.alignment_prompts(flat, max_slots), model, M.ALIGN_SYSTEM)
    opinions, _ = M.parse_alignment(answers, sources, max_slots)
    opinions = cut(opinions)
    rows = opinions.select("merge_group", "key", "value", "evidence", F.col("quote").alias("text"), "source", "slot_type", "routes", F.lit(0).alias("trust"), F.struct("at", "o_at").alias("claim_ord"))
    if trust is not None:
        rows = rows.drop("trust").join(trust.select(F.col("source").alias("_s"), "trust"), F.col("source") == F.col("_s"), "left").drop("_s").withColumn("trust", F.coalesce("trust", F.lit(0)))
    state, slots = decided_slots(rows, score)
    ties = slots.where("outcome = 'disputed'").groupBy("merge_group").agg(F.count("*").alias("conflicts"), F.lit("skipped").alias("adjudication"))
    if adjudicate:
        slots, ties = settled(cut(slots), rows, model)
    # routes of all claims of a slot, of whatever value, in the order of the claims
    ordered = F.array_sort(F.collect_list(F.when(F.size("routes") > 0, F.struct("claim_ord", "routes"))))
    routes = rows.groupBy(*KEYS).agg(D.distinct_routes(F.flatten(F.transform(ordered, lambda x: x["routes"]))).alias("routes"))
    resolution = F.col("resolution") if "resolution" in slots.columns else None
    slots = cut(D.derive(cut(slots.join(routes, KEYS).withColumn("asserted", D.asserted(F.col("outcome"), resolution))), ["merge_group"]))
    groups = slots.select("merge_group").distinct()
    report = _reported(groups, groups.withColumn("mode", F.lit("llm")), ties, D.counters(slots, ["merge_group"]))
    return Merged(rows, state, slots, redacted_counts(C.blocks(messages)), report)


def _left_over(messages: DataFrame, merged: Merged) -> DataFrame:
    done = merged.slots.select(F.col("merge_group").alias("_g")).distinct()
    return messages.join(done, F.col("merge_group") == F.col("_g"), "left_anti")


def merge_aligned(messages: DataFrame, model: M.Model, trust: DataFrame | None = None, score: str = "egalitarian", adjudicate: bool = True, max_slots: int = 40, max_chars: int = 6000, **options) -> DataFrame:
    """messages with merge_group to one rendered block each, aligned by a model where its answer holds."""
    merged = aligned(messages, model, trust, score, adjudicate, max_slots, max_chars)
    out, left = merged.render(**options), _left_over(messages, merged)
    return out if left.isEmpty() else out.unionByName(merge_sessions(left, trust, score, **options))


def guarded(merged: Merged, **options) -> DataFrame:
    """One row for each merge group: its block, or, if its slots break a rule of trust, none.

    n_slots, violations, refused, injected (there is content to give), redacted,
    the report's columns, reason, included, tokens, text ('' unless injected).
    """
    rules = D.trust_violations(merged.claims, merged.values_shown(), ["merge_group"]).groupBy("merge_group").agg(F.count("*").alias("violations"))
    sizes = merged.slots.groupBy("merge_group").agg(F.count("*").alias("n_slots"))
    blocks = merged.render(**options).select("merge_group", "text", "included", "tokens", "reason")
    rows = sizes.join(rules, "merge_group", "left").join(merged.redacted, "merge_group", "left").join(merged.report, "merge_group", "left").join(blocks, "merge_group", "left")
    violations = F.coalesce("violations", F.lit(0)).cast("long")
    rows = rows.withColumns({"violations": violations, "refused": violations > 0})
    injected = ~F.col("refused") & (F.coalesce("included", F.lit(0)) > 0)
    why = F.when(F.col("refused"), "trust").when(~injected, F.coalesce("reason", F.lit("nothing-to-say")))
    return rows.select(
        "merge_group", "n_slots", "violations", "refused", injected.alias("injected"), F.coalesce("redacted", F.lit(0)).cast("long").alias("redacted"), *REPORT,
        why.alias("reason"), F.when(injected, F.col("included")).otherwise(0).cast("long").alias("included"), F.when(injected, F.col("tokens")).otherwise(0).cast("long").alias("tokens"), F.when(injected, F.col("text")).otherwise("").alias("text"),
    )


def apply_step(messages: DataFrame, model: M.Model | None = None, trust: DataFrame | None = None, score: str = "egalitarian", for_query: bool = False, **options) -> DataFrame:
    """What is put before a conversation's next step, a row for each merge group as ``guarded`` says.

    messages: those of the sources; a row of a running session itself is marked
    ``own`` and never a source, its latest user text weighs the packing of its
    group if for_query.
    """
    own = messages.where("own") if "own" in messages.columns else messages.where("false")
    sources = messages.where("not own").drop("own") if "own" in messages.columns else messages
    if for_query:
        asked = C.latest_user_text(own.drop("own")).join(own.select("session_id", "merge_group").distinct(), "session_id").groupBy("merge_group").agg(F.max("text").alias("query"))
        options["queries"] = asked
    if model is None:
        return guarded(heuristic(sources, trust, score), **options)
    merged = aligned(sources, model, trust, score)
    out, left = guarded(merged, **options), _left_over(sources, merged)
    return out if left.isEmpty() else out.unionByName(guarded(heuristic(left, trust, score), **options))
