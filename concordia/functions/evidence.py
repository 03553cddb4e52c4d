"""Evidence, trust and slot decisions as expressions.

A slot's state is an array of (value, source, evidence) structs without
repeats: the triple is the identity, so one source that asserts a value at
two levels counts with both.  ``decide`` needs no shuffle; table forms of the
same rules are in ``operators.slots``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPECULATIVE, INFERRED, TOOL_VERIFIED, USER_STATED = 1, 2, 3, 4
TRUST_NAMES = ("untrusted", "external", "trusted")
SLOT_TYPES = ("Fact", "Decision", "Constraint", "Refuted", "Goal", "OpenQ", "Artifact")
MERGED = "*merged*"

ITEM = "struct<value:string,source:string,evidence:int>"
STATE = f"array<{ITEM}>"


def weight(evidence: Column) -> Column:
    """1, 2, 4, 8 for levels 1 to 4; other levels weigh nothing."""
    return F.when(evidence == 1, 1).when(evidence == 2, 2).when(evidence == 3, 4).when(evidence == 4, 8).otherwise(0)


def speaker(role: Column, block_type: Column, injected: Column) -> Column:
    return F.when(injected, "injected").when(block_type == "reasoning", "reasoning").when(role == "user", "user").when(role == "tool", "tool").otherwise("assistant")


def evidence_for(role: Column, block_type: Column, injected: Column) -> Column:
    return (
        F.when(injected, SPECULATIVE).when(block_type == "reasoning", SPECULATIVE).when(role == "user", USER_STATED).when(role == "tool", TOOL_VERIFIED).otherwise(INFERRED)
    )


def clamp_evidence(raw: Column) -> Column:
    """raw: the JSON text of a level (null: absent). Rounded half up into 1-4; what is no number is 2, JSON null and '' are 0."""
    bare = F.trim(F.regexp_replace(raw, '^"|"$', ""))
    n = F.when(raw == "null", 0.0).when(bare == "", 0.0).when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(F.expr("null").cast("double"))
    n = F.coalesce(n, F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double")))
    return F.when(n.isNull(), 2).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.floor(n + 0.5).cast("int"))))


def trust_level(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low == "trusted", 2).when(low == "external", 1).otherwise(0)


def trust_name(level: Column) -> Column:
    return F.when(level == 2, "trusted").when(level == 1, "external").otherwise("untrusted")


def _supports(state: Column, value: Column) -> Column:
    return F.transform(F.filter(state, lambda i: i["value"] == value), lambda i: i["evidence"])


def egalitarian(state: Column, value: Column) -> Column:
    """Sum of weights, as a one-element array so that both scores compare alike."""
    return F.array(F.aggregate(_supports(state, value), F.lit(0), lambda a, e: a + weight(e)))


def elitist(state: Column, value: Column) -> Column:
    """Levels from the highest down; arrays compare element by element, a beginning below the longer."""
    return F.sort_array(_supports(state, value), asc=False)


SCORES = {"egalitarian": egalitarian, "elitist": elitist}


def values_of(state: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(state, lambda i: i["value"])))


def winners(state: Column, score: str = "egalitarian") -> Column:
    """Values of the best score, sorted; one is a decision, more are a dispute, none an empty slot."""
    rule = SCORES[score]
    scored = F.transform(values_of(state), lambda v: F.struct(rule(state, v).alias("score"), v.alias("value")))
    bound = F.transform(F.array(scored), lambda s: F.transform(F.filter(s, lambda x: x["score"] == F.array_max(F.transform(s, lambda y: y["score"]))), lambda x: x["value"]))
    return F.element_at(bound, 1)


def decision_of(best: Column) -> Column:
    """(outcome, winner, tied) from the winners."""
    n = F.size(best)
    return F.struct(
        F.when(n == 0, "empty").when(n == 1, "resolved").otherwise("disputed").alias("outcome"),
        F.when(n == 1, F.element_at(best, 1)).alias("winner"),
        F.when(n > 1, best).otherwise(F.array().cast("array<string>")).alias("tied"),
    )


def decision_text(best: Column) -> Column:
    """A decision as one string: empty, resolved:v or disputed:v,w."""
    n = F.size(best)
    return F.when(n == 0, "empty").when(n == 1, F.concat(F.lit("resolved:"), F.element_at(best, 1))).otherwise(F.concat(F.lit("disputed:"), F.array_join(best, ",")))


def keep_all(state: Column, score: str) -> Column:
    """JOIN: the state as it is; the only representation that any order of arrival may fold."""
    return state


def keep_best_level(state: Column, score: str) -> Column:
    """MAX: each winner with its highest level, under one made-up source."""
    def one(v: Column) -> Column:
        return F.struct(v.alias("value"), F.lit(MERGED).alias("source"), F.array_max(_supports(state, v)).alias("evidence"))

    return F.transform(winners(state, score), one)


def keep_levels(state: Column, score: str) -> Column:
    """COUNT: each winner with all its levels, under numbered made-up sources."""
    def of(v: Column) -> Column:
        levels = F.sort_array(_supports(state, v), asc=False)
        return F.transform(levels, lambda e, i: F.struct(v.alias("value"), F.concat(F.lit(MERGED + ":"), i.cast("string")).alias("source"), e.alias("evidence")))

    return F.flatten(F.transform(winners(state, score), of))


REPRESENTATIONS = {"JOIN": keep_all, "COUNT": keep_levels, "MAX": keep_best_level}


def fold(branches: list[Column], score: str, representation: str) -> Column:
    """Branch states merged one by one in the given order; the first is taken as it is.

    The steps are unrolled, each bound once, so an expression over n branches
    evaluates n - 1 merges.
    """
    keep = REPRESENTATIONS[representation]
    acc = branches[0]
    for b in branches[1:]:
        acc = F.element_at(F.transform(F.array(F.array_union(acc, b)), lambda s: keep(s, score)), 1)
    return acc
