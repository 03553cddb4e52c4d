"""What models answer: alignments of sources and settlements of ties, checked field by field.

A model is any callable (system, prompt, max_tokens) -> text.  Its answers are
not reproducible, so they are taken once on the driver, one for each merge
group, and parsed from a materialised table; nothing here calls a model inside
a stage that Spark may run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..plans.store import cut
from . import derive as D

Model = Callable[[str, str, int], str]

ALIGN_SCHEMA = "slots array<string>"
SLOT_SCHEMA = "key string, type string, derivedFrom array<string>, opinions array<string>"
OPINION_SCHEMA = "source string, value string, evidence string, quote string"
RESOLUTION_SCHEMA = "key string, outcome string, value string, premises array<string>, rationale string, guard string"

# Outcomes of an adjudication.
OUTCOMES = ("choose", "both", "conditional", "unresolvable")

ALIGN_SYSTEM = (
    "You read several conversations and list what each says about each question. Answer with one JSON object {\"slots\": [...]}. A slot has a key (dotted, lower case), "
    f"a type ({', '.join(E.SLOT_TYPES)}), opinions and, if it was concluded from other slots, derivedFrom with their keys. An opinion has the source id as given, a short "
    "lower-case value, an evidence level (4 stated by the user, 3 verified by a tool, 2 concluded, 1 guessed) and a verbatim quote. One slot for one question, whatever the wording. Invent nothing."
)
SETTLE_SYSTEM = (
    "You settle ties between opinions of equal evidence. For each CONFLICT answer choose (with one of its values), both, conditional (with a guard) or unresolvable, "
    "as one JSON object {\"resolutions\": [{\"key\", \"outcome\", \"value\", \"guard\", \"premises\", \"rationale\"}]}. Prefer unresolvable to a guess."
)


def alignment_prompts(flat: DataFrame, max_slots: int = 40) -> DataFrame:
    """(merge_group, prompt) from flattened sources (merge_group, session_id, text, truncated)."""
    part = F.concat(F.lit("### source "), F.col("session_id"), F.when(F.col("truncated"), " (cut)").otherwise(""), F.lit("\n"), F.col("text"))
    per = flat.groupBy("merge_group").agg(F.sort_array(F.collect_list(F.struct("session_id", part.alias("part")))).alias("p"))
    ids = F.array_join(F.transform("p", lambda x: x["session_id"]), ", ")
    parts = F.array_join(F.transform("p", lambda x: x["part"]), "\n")
    return per.select("merge_group", F.concat(F.lit("Sources: "), ids, F.lit(f"\nAt most {max_slots} slots.\n\n"), parts).alias("prompt"))


def settlement_prompts(options: DataFrame, backwards: bool = False) -> DataFrame:
    """(merge_group, prompt) from options (merge_group, key, value, quotes array<string>); backwards: in reverse order."""
    line = F.concat(F.lit("  - "), F.col("value"), F.lit(": "), F.array_join("quotes", " / "))
    per = options.groupBy("merge_group", "key").agg(F.sort_array(F.collect_list(F.struct("value", line.alias("line"))), asc=not backwards).alias("o"))
    text = F.concat(F.lit("CONFLICT "), F.col("key"), F.lit("\n"), F.array_join(F.transform("o", lambda x: x["line"]), "\n"))
    whole = per.groupBy("merge_group").agg(F.sort_array(F.collect_list(F.struct("key", text.alias("t"))), asc=not backwards).alias("c"))
    return whole.select("merge_group", F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("prompt"))


def ask(prompts: DataFrame, model: Model, system: str, max_tokens: int = 4000) -> DataFrame:
    """(merge_group, answer), asked once; a failing call gives a null answer."""

    def answer(prompt: str) -> str | None:
        try:
            return model(system, prompt, max_tokens)
        except Exception:  # noqa: BLE001  whatever a model raises, the merge goes on without it
            return None

    kind = dict(prompts.dtypes)["merge_group"]
    rows = [(r["merge_group"], answer(r["prompt"])) for r in prompts.toLocalIterator()]
    return cut(prompts.sparkSession.createDataFrame(rows, f"merge_group {kind}, answer string"))


def parse_alignment(answers: DataFrame, sources: DataFrame, max_slots: int = 40) -> tuple[DataFrame, DataFrame]:
    """(opinions, rejects) from (merge_group, answer); sources: (merge_group, source).

    opinions: merge_group, key, slot_type, source, value, evidence, quote,
    derived_from, routes (nested premises are alternatives), at and o_at (place in the answer).  rejects: merge_group, reason, n.  Keys and values are
    trimmed and in lower case, the first slot of a key counts, unknown sources
    and empty values go, and the cap holds after sorting by key.
    """
    parsed = answers.select("merge_group", F.from_json(T.json_object(F.col("answer")), ALIGN_SCHEMA).alias("j"))
    slots = parsed.select("merge_group", F.posexplode("j.slots").alias("at", "raw")).withColumn("s", F.from_json("raw", SLOT_SCHEMA))
    key = F.lower(T.trim(F.coalesce("s.key", F.lit(""))))
    no_object = F.coalesce(~F.col("raw").startswith("{"), F.lit(True))
    slots = slots.select("merge_group", "at", key.alias("key"), F.when(no_object, "not-object").when(F.length(key) == 0, "bad-key").alias("reason"), "s")
    usable = slots.where("reason is null")
    known = sources.select("merge_group", F.col("source").alias("_known")).distinct()
    each = usable.select("merge_group", "at", "key", F.col("s.type").alias("type"), F.col("s.derivedFrom").alias("derived_from"), F.posexplode_outer("s.opinions").alias("o_at", "o_raw")).withColumn("o", F.from_json("o_raw", OPINION_SCHEMA))
    each = each.join(known, (each["merge_group"] == known["merge_group"]) & (F.col("o.source") == F.col("_known")), "left").drop(known["merge_group"])
    value = F.lower(T.trim(F.coalesce("o.value", F.lit(""))))
    each = each.withColumn("value", value).withColumn("reason", F.when(F.col("o_raw").isNull(), "no-opinions").when(F.col("_known").isNull(), "unknown-source").when(F.length("value") == 0, "empty-value"))
    good = each.where("reason is null")
    filled = good.groupBy("merge_group", "at", "key").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("merge_group", "key").orderBy("at"))
    ranked = filled.withColumn("_first", first)
    chosen = ranked.where("_first = 1").withColumn("_rank", F.row_number().over(Window.partitionBy("merge_group").orderBy("key"))).where(F.col("_rank") <= max_slots)
    rows = good.join(chosen.select("merge_group", "at", F.col("key").alias("_k")), ["merge_group", "at"])
    clean = F.array_distinct(F.filter(F.coalesce("derived_from", F.array().cast("array<string>")), lambda k: F.length(k) > 0))
    routes = D.routes_of(F.col("derived_from"))
    opinions = rows.select(
        "merge_group", "key", F.when(F.col("type").isin(*E.SLOT_TYPES), F.col("type")).otherwise("Fact").alias("slot_type"), F.col("o.source").alias("source"), "value",
        F.coalesce(E.clamp_evidence(F.when(F.col("o_raw").rlike('"evidence"\\s*:\\s*null'), "null").otherwise(F.col("o.evidence"))), F.lit(2)).alias("evidence"),
        F.when(F.length(F.coalesce("o.quote", F.lit(""))) > 0, F.col("o.quote")).otherwise(F.concat("key", F.lit(" = "), "value")).alias("quote"), clean.alias("derived_from"), routes.alias("routes"), "at", "o_at",
    )
    repeated = ranked.where("_first > 1").select("merge_group", F.lit("bad-key").alias("reason"))
    rejects = slots.where("reason is not null").select("merge_group", "reason").unionByName(each.where("reason is not null").select("merge_group", "reason")).unionByName(repeated)
    return opinions, rejects.groupBy("merge_group", "reason").agg(F.count("*").alias("n"))


def parse_settlements(answers: DataFrame, options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolutions, rejects) from (merge_group, answer); options: (merge_group, key, value) of the conflicts asked about."""
    parsed = answers.select("merge_group", F.from_json(T.json_object(F.col("answer")), "resolutions array<string>").alias("j"))
    rows = parsed.select("merge_group", F.posexplode("j.resolutions").alias("at", "raw")).withColumn("r", F.from_json("raw", RESOLUTION_SCHEMA))
    allowed = options.groupBy("merge_group", "key").agg(F.collect_set("value").alias("_allowed"))
    rows = rows.select("merge_group", "at", F.coalesce("r.key", F.lit("")).alias("key"), "r").join(allowed, ["merge_group", "key"], "left")
    value = F.lower(T.trim(F.coalesce("r.value", F.lit(""))))
    guard = T.trim(F.coalesce("r.guard", F.lit("")))
    reason = (
        F.when(F.col("_allowed").isNull(), "unknown-key").when(~F.coalesce(F.col("r.outcome").isin(*OUTCOMES), F.lit(False)), "bad-outcome")
        .when((F.col("r.outcome") == "choose") & ~F.array_contains("_allowed", value), "invented-value").when((F.col("r.outcome") == "conditional") & (F.length(guard) == 0), "missing-guard")
    )
    rows = rows.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("merge_group", "key").orderBy("at"))
    good = rows.where("reason is null").withColumn("_first", first)
    chosen = good.where("_first = 1").select(
        "merge_group", "key", F.col("r.outcome").alias("outcome"), F.when(F.col("r.outcome") == "choose", value).alias("value"), F.when(F.col("r.outcome") == "conditional", guard).alias("guard"),
        F.coalesce("r.premises", F.array().cast("array<string>")).alias("premises"), F.coalesce("r.rationale", F.lit("")).alias("rationale"),
    )
    twice = good.where("_first > 1").select("merge_group", F.lit("duplicate").alias("reason"))
    return chosen, rows.where("reason is not null").select("merge_group", "reason").unionByName(twice).groupBy("merge_group", "reason").agg(F.count("*").alias("n"))


def reconcile(forward: DataFrame, backward: DataFrame, keys: list[str]) -> DataFrame:
    """forward's answers that the reversed run gives too; other than that, unresolvable; without a reversed answer, none."""
    b = backward.select(*keys, F.col("outcome").alias("_o"), F.col("value").alias("_v"))
    met = forward.join(b, keys)
    agree = (F.col("outcome") == F.col("_o")) & ((F.col("outcome") != "choose") | (F.col("value") == F.col("_v")))
    return met.select(
        *keys, F.when(agree, F.col("outcome")).otherwise("unresolvable").alias("outcome"), F.when(agree, F.col("value")).alias("value"),
        F.when(agree, F.col("guard")).alias("guard"), (~agree).alias("order_sensitive"),
    )
