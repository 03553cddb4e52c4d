"""From messages to claims: redaction, sentences, polarity and keys, as one narrow plan without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T

CUT_MARK = "…(older content cut)…\n"


def blocks(messages: DataFrame, reasoning: bool = True, injected: bool = False) -> DataFrame:
    """Redacted text blocks in order: the only way from messages to text.

    Keeps text and reasoning blocks (no type counts as text) with non-blank
    text; ``redacted`` counts the credentials taken out.
    """
    from_plugin = F.coalesce(F.col("source_kind") == "plugin", F.lit(False))
    rows = messages.withColumn("injected", from_plugin)
    if not injected:
        rows = rows.where(~F.col("injected"))
    rows = rows.select("*", F.posexplode("blocks").alias("block_idx", "b"))
    kind = F.coalesce(F.col("b.type"), F.lit("text"))
    rows = rows.withColumn("block_type", kind).where(F.col("block_type").isin("text", "reasoning") & F.col("b.text").isNotNull())
    if not reasoning:
        rows = rows.where("block_type <> 'reasoning'")
    role = F.coalesce("role", F.lit("assistant"))
    kept = [*[c for c in messages.columns if c not in ("blocks", "role")], role.alias("role"), "injected", "block_idx", "block_type"]
    rows = rows.select(*kept, F.col("b.text").alias("text"), T.redact(F.col("b.text")).alias("_clean"))
    count = T.redactions(F.col("text"), F.col("_clean"))
    return rows.withColumns({"redacted": count, "text": T.trim(F.col("_clean"))}).drop("_clean").where(F.length("text") > 0)


def claims(messages: DataFrame, strategy: str = "exact", reasoning: bool = True, injected: bool = False) -> DataFrame:
    """One row for each sentence: key, value (assert or refute), evidence, text, source, claim_ord.

    A sentence and its negation share a key. claim_ord orders the claims of a
    source as they stand in its log.
    """
    return claims_of(blocks(messages, reasoning, injected), strategy)


def claims_of(rows: DataFrame, strategy: str = "exact") -> DataFrame:
    """As ``claims``, from blocks that are there already."""
    own = ("role", "source_kind", "injected", "block_idx", "block_type", "text", "redacted")
    kept = [c for c in rows.columns if c not in own]
    rows = rows.select("*", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_idx", "sentence"))
    level = E.evidence_for(F.col("role"), F.col("block_type"), F.col("injected"))
    out = rows.select(
        *kept,
        T.normalise_key(T.without_negation(F.col("sentence")), strategy).alias("key"),
        F.when(T.is_negated(F.col("sentence")), "refute").otherwise("assert").alias("value"),
        level.alias("evidence"), F.col("sentence").alias("text"), F.col("session_id").alias("source"),
        F.struct("seq", "block_idx", "sentence_idx").alias("claim_ord"),
    )
    return out.where(F.length("key") > 0)


def flatten(messages: DataFrame, max_chars: int = 6000, reasoning: bool = True, injected: bool = False) -> DataFrame:
    """One labelled text for each session, cut to its last max_chars UTF-16 units behind a mark."""
    rows = blocks(messages, reasoning, injected)
    label = E.speaker(F.col("role"), F.col("block_type"), F.col("injected"))
    line = F.concat(F.lit("["), label, F.lit("] "), F.col("text"))
    per = rows.groupBy("session_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "block_idx", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), F.sum("redacted").alias("redacted")
    )
    long = T.utf16_length(F.col("text")) > max_chars
    return per.select("session_id", F.when(long, F.concat(F.lit(CUT_MARK), T.utf16_tail(F.col("text"), max_chars))).otherwise(F.col("text")).alias("text"), long.alias("truncated"), "redacted")


def truncate_lines(texts: DataFrame, budget_tokens: int, key: str = "session_id") -> DataFrame:
    """Leading lines of each text while their running length stays within four units a token."""
    most = max(0, budget_tokens) * 4
    lines = F.split("text", "\n")
    kept = F.aggregate(
        lines, F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("out"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"] | (a["used"] + T.utf16_length(x) + 1 > most), F.struct(a["used"].alias("used"), a["out"].alias("out"), F.lit(True).alias("full")))
        .otherwise(F.struct((a["used"] + T.utf16_length(x) + 1).alias("used"), F.array_append(a["out"], x).alias("out"), F.lit(False).alias("full"))),
    )
    whole = T.utf16_length(F.col("text")) <= most
    return texts.select(key, F.when(whole, F.col("text")).otherwise(F.array_join(kept["out"], "\n")).alias("text"))


def latest_user_text(messages: DataFrame) -> DataFrame:
    """The last non-blank text of a user in each session."""
    rows = blocks(messages).where("role = 'user'")
    return rows.groupBy("session_id").agg(F.max_by("text", F.struct("seq", "block_idx")).alias("text"))


#: Values of a query set looked for in one pass over a text.
VALUE_BLOCK = 256


def mention_counts(texts: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, n_documents): how many rows of texts (text) mention each of the values (key, value).

    values is a stated query set, held by the driver: each text is normalised
    once and searched for all of it, in blocks; counts combine before they shuffle.
    """
    wanted = values.select(key, T.normalise_mention(F.col("value")).alias("needle"))
    asked = sorted({r["needle"] for r in wanted.collect() if r["needle"]})
    plain = texts.where(F.col("text").isNotNull()).select(T.normalise_mention(F.col("text")).alias("plain"))
    blocks = [asked[k : k + VALUE_BLOCK] for k in range(0, len(asked), VALUE_BLOCK)]
    held = [F.filter(F.array(*map(F.lit, b)), lambda w: F.contains(F.col("plain"), w)) for b in blocks]
    met = plain.select(F.explode(F.concat(*held) if len(held) > 1 else held[0]).alias("needle")) if held else wanted.where("false").select("needle")
    counts = met.groupBy("needle").agg(F.count("*").alias("n_documents"))
    return wanted.join(F.broadcast(counts), "needle", "left").select(key, F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"))
