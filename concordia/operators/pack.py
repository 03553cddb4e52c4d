"""Choosing slots for a token budget: utility, layout and the packing solver.

Utilities and orders are plain expressions over a table of slots.  The solver
is sequential by nature (each pick changes what the next is worth), so it runs
once for each merge group in a grouped Arrow function; a group's slots are few
columns of numbers, never its texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import ship

# What a slot's type is worth, and how long it stays as it is.
TYPE_VALUE = {"Constraint": 3.0, "Goal": 3.0, "Decision": 2.5, "Refuted": 2.0, "Fact": 1.5, "OpenQ": 1.0, "Artifact": 1.0}
TYPE_STABILITY = {"Constraint": 4.0, "Goal": 4.0, "Decision": 3.0, "Refuted": 2.0, "Fact": 2.0, "Artifact": 1.0, "OpenQ": 0.5}


@dataclass(frozen=True)
class Weights:
    evidence: float = 3.0
    corroboration: float = 2.0
    trust: float = 4.0
    relevance: float = 2.0
    other_type: float = 1.0
    coverage: float = 6.0
    gamma: float = 0.7
    retracted: float = 0.05
    type_value: dict[str, float] = field(default_factory=lambda: dict(TYPE_VALUE))


DEFAULT = Weights()


def _lookup(kind: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def features(state: DataFrame, claims: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Per slot: max_evidence, n_sources (over all values), trust of the winner or of what is tied."""
    per = state.groupBy(*keys).agg(F.max("evidence").alias("max_evidence"), F.countDistinct("source").alias("n_sources"))
    shown = decided.select(*keys, F.explode(F.when(F.col("outcome") == "resolved", F.array("winner")).otherwise(F.col("tied"))).alias("value"))
    trust = shown.join(claims.select(*keys, "value", "trust"), [*keys, "value"]).groupBy(*keys).agg(F.max(F.coalesce("trust", F.lit(0))).alias("trust"))
    return decided.join(per, keys).join(trust, keys, "left").withColumn("trust", F.coalesce("trust", F.lit(0)))


def personal_utility(w: Weights = DEFAULT, kind: str = "slot_type", rel: Column | None = None, retracted: Column | None = None) -> Column:
    raw = _lookup(F.coalesce(F.col(kind), F.lit("Fact")), w.type_value, w.other_type) + w.evidence * F.col("max_evidence") + w.corroboration * F.col("n_sources") + w.trust * F.col("trust")
    raw = raw + w.relevance * (F.lit(0.0) if rel is None else rel)
    return raw if retracted is None else F.when(retracted, raw * w.retracted).otherwise(raw)


def stability(kind: str = "slot_type") -> Column:
    settled = F.when(F.col("outcome") == "resolved", 3.0).otherwise(0.0)
    return _lookup(F.coalesce(F.col(kind), F.lit("Fact")), TYPE_STABILITY, 1.0) + settled + 0.5 * F.col("max_evidence") + 0.5 * F.col("n_sources") + 0.25 * F.col("trust")


def priority() -> Column:
    return F.col("max_evidence") * 100 + F.col("n_sources") * 10


def ordered(slots: DataFrame, groups: list[str], by: Column, name: str = "position", key: str = "key") -> DataFrame:
    """slots with their 1-based place in descending order of ``by``, ties by key, within each group."""
    return slots.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(by.desc(), key)))


def common_prefix(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """Per group, how many leading places of two layouts (position, key) hold the same key."""
    left, right = a.select(*groups, "position", F.col("key").alias("_a")), b.select(*groups, "position", F.col("key").alias("_b"))
    met = left.join(right, [*groups, "position"], "full")
    differ = F.min(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("position")))
    return met.groupBy(*groups).agg((F.coalesce(differ - 1, F.max("position"))).cast("long").alias("prefix"))


# --- the solver (plain numbers of one group) -----------------------------------


@dataclass
class Slots:
    key: list[str]
    kind: list[str]
    cost: list[int]
    worth: list[float]


def coverage_gain(kind: str, n: int, w: Weights = DEFAULT) -> float:
    """What one more slot of a type adds when there are n."""
    scale = w.coverage * w.type_value.get(kind, w.other_type) * 0.1
    return scale * (math.exp(-w.gamma * n) - math.exp(-w.gamma * (n + 1)))


def set_utility(s: Slots, chosen: list[int], w: Weights = DEFAULT) -> float:
    total, counts = 0.0, {}
    for i in chosen:
        total += s.worth[i]
        counts[s.kind[i]] = counts.get(s.kind[i], 0) + 1
    return total + sum(w.coverage * w.type_value.get(k, w.other_type) * 0.1 * (1 - math.exp(-w.gamma * n)) for k, n in counts.items())


def by_density(s: Slots, budget: int, seed: tuple[int, ...] = (), w: Weights = DEFAULT, among: list[int] | None = None) -> list[int]:
    """Picks by gain for each token from a seed on; of equal ones the smaller key. among: the slots that may be picked (all)."""
    chosen, used, counts = list(seed), sum(s.cost[i] for i in seed), {}
    for i in seed:
        counts[s.kind[i]] = counts.get(s.kind[i], 0) + 1
    left = np.array([i for i in (range(len(s.key)) if among is None else among) if i not in set(seed)], int)
    cost, worth = np.array(s.cost)[left], np.array(s.worth, float)[left]
    kinds = sorted({s.kind[i] for i in left})
    kind = np.array([kinds.index(s.kind[i]) for i in left], int)
    gain = np.array([coverage_gain(k, counts.get(k, 0), w) for k in kinds])
    free = np.ones(len(left), bool)
    while True:
        free &= used + cost <= budget  # what does not fit now never will
        at = np.flatnonzero(free)
        if not len(at):
            return chosen
        density = (worth[at] + gain[kind[at]]) / cost[at]
        best = min(at[density == density.max()].tolist(), key=lambda i: s.key[left[i]])
        free[best] = False
        pick, k = int(left[best]), s.kind[left[best]]
        chosen.append(pick)
        used += s.cost[pick]
        counts[k] = counts.get(k, 0) + 1
        gain[kind[best]] = coverage_gain(k, counts[k], w)


def _useful(s: Slots, fits: list[int], budget: int) -> list[int]:
    """Of slots of one type and cost, the first by worth and key, as many as a budget holds: a packing with another one is no better."""
    alike: dict[tuple[str, int], list[int]] = {}
    for i in sorted(fits, key=lambda i: (-s.worth[i], s.key[i])):
        alike.setdefault((s.kind[i], s.cost[i]), []).append(i)
    return sorted(i for (_, cost), xs in alike.items() for i in (xs[: budget // cost] if cost > 0 else xs))


def pack(s: Slots, budget: int, algorithm: str = "partial", seed_size: int = 2, w: Weights = DEFAULT) -> tuple[list[int], str]:
    """(chosen slots in order of choice, algorithm that found them). ``partial`` also starts from every small subset.

    A start is left out only where it cannot lead to more: its own worth and
    what the rest of the budget could hold in fractions, each slot counted as
    the first of its type, is a bound.
    """
    fits = [i for i in range(len(s.key)) if s.cost[i] <= budget]
    if not fits:
        return [], algorithm
    best, how = by_density(s, budget, (), w, fits), "density"
    if algorithm != "partial":
        return best, how
    size = min(seed_size, len(fits))
    useful = _useful(s, fits, budget)
    if len(useful) < size:
        useful = fits
    most = {i: s.worth[i] + coverage_gain(s.kind[i], 0, w) for i in useful}
    dense = sorted((i for i in useful if most[i] > 0), key=lambda i: -most[i] / s.cost[i] if s.cost[i] > 0 else -math.inf)

    def rest(room: int, seed: tuple[int, ...]) -> float:
        total = 0.0
        for i in dense:
            if i in seed:
                continue
            if s.cost[i] >= room > 0:
                return total + most[i] * room / s.cost[i]
            if s.cost[i] <= room:
                total += most[i]
                room -= s.cost[i]
            elif room <= 0:
                return total
        return total

    room_for = [rest(b, ()) for b in range(budget + 1)]
    value, edge = set_utility(s, best, w), 1e-6
    starts = []
    for seed in combinations(useful, size):
        room = budget - sum(s.cost[i] for i in seed)
        if room >= 0:
            own = sum(most[i] for i in seed)
            if own + room_for[room] >= value - edge and (bound := own + rest(room, seed)) >= value - edge:
                starts.append((-bound, seed))
    starts.sort()
    first: tuple[int, ...] = ()
    for bound, seed in starts:
        if -bound < value - edge:
            break
        got = by_density(s, budget, seed, w, useful)
        found = set_utility(s, got, w)
        if found > value or (found == value and how == "partial" and seed < first):
            best, value, how, first = got, found, "partial", seed
    return best, how


def pack_groups(slots: DataFrame, groups: list[str], budget: int, algorithm: str = "partial", w: Weights = DEFAULT) -> DataFrame:
    """slots (groups, key, slot_type, cost, worth) with selected, and per group tokens, utility, algorithm.

    A budget column of the same name overrides the constant.
    """
    ship(slots.sparkSession)
    own = "budget" in slots.columns
    need = slots.select(*groups, "key", "slot_type", "cost", "worth", *(["budget"] if own else []))

    def task(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        s = Slots(t["key"].to_pylist(), t["slot_type"].to_pylist(), t["cost"].to_pylist(), t["worth"].to_pylist())
        chosen, how = pack(s, t["budget"][0].as_py() if own else budget, algorithm, w=w)
        picked = set(chosen)
        n = t.num_rows
        return t.select([*groups, "key"]).append_column("selected", pa.array([i in picked for i in range(n)])).append_column("tokens", pa.array([sum(s.cost[i] for i in chosen)] * n, pa.int64())).append_column("utility", pa.array([set_utility(s, chosen, w)] * n)).append_column("algorithm", pa.array([how] * n))

    kinds = dict(need.dtypes)
    schema = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", key string, selected boolean, tokens bigint, utility double, algorithm string"
    return need.groupBy(*groups).applyInArrow(task, schema)
