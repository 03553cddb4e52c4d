"""Does folding branches one by one give what merging them at once gives, whatever the order?

Profiles are numbers: a profile of n branches over T templates is an id below
T**n whose digits are templates, so a space is a ``range`` and every profile
is decoded, folded in all orders and compared within its row, without a
shuffle before the final count.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E

#: name: (values, evidence levels, branches)
SPACES = {"A": (("a", "b", "c"), (1, 2), 3), "B": (("a", "b"), (1, 2, 3, 4), 3)}


def n_templates(values: tuple[str, ...], levels: tuple[int, ...], well_formed: bool) -> int:
    return 1 + len(values) * len(levels) if well_formed else (len(levels) + 1) ** len(values)


def branch_state(template: Column, source: str, values: tuple[str, ...], levels: tuple[int, ...], well_formed: bool) -> Column:
    """The state of a branch: the template's digits give each value's level, 0 for none."""
    base = len(levels) + 1
    levels_ = F.array(*map(F.lit, levels))
    if well_formed:  # at most one opinion: template 0 is none, then value by value, level by level
        at = template - 1
        value = F.element_at(F.array(*map(F.lit, values)), (F.floor(at / len(levels)) + 1).cast("int"))
        level = F.element_at(levels_, (at % len(levels) + 1).cast("int"))
        one = F.array(F.struct(value.alias("value"), F.lit(source).alias("source"), level.alias("evidence")))
        return F.when(template > 0, one).otherwise(F.array().cast(E.STATE))
    items = []
    for k, v in enumerate(values):
        digit = F.floor(template / base ** (len(values) - 1 - k)) % base
        items.append(F.when(digit > 0, F.struct(F.lit(v).alias("value"), F.lit(source).alias("source"), F.element_at(levels_, F.greatest(digit, F.lit(1)).cast("int")).alias("evidence"))))
    return F.filter(F.array(*items), lambda i: i.isNotNull())


def profiles(spark: SparkSession, space: str, well_formed: bool) -> DataFrame:
    """(space, well_formed, profile_id, b0, b1, ...): every profile of a space."""
    values, levels, n = SPACES[space]
    t = n_templates(values, levels, well_formed)
    rows = spark.range(t**n, numPartitions=max(1, min(64, t**n // 400))).withColumnRenamed("id", "profile_id")
    branches = [branch_state(F.floor(F.col("profile_id") / t ** (n - 1 - k)) % t, f"b{k}", values, levels, well_formed).alias(f"b{k}") for k in range(n)]
    return rows.select(F.lit(space).alias("space"), F.lit(well_formed).alias("well_formed"), "profile_id", *branches)


def violations(rows: DataFrame, n: int, score: str, representation: str) -> DataFrame:
    """rows with size (assertions), nary, violated: some order of folding decides otherwise."""
    names = [F.col(f"b{k}") for k in range(n)]
    nary = E.decision_text(E.winners(F.array_union(F.array_union(names[0], names[1]), names[2]) if n == 3 else F.flatten(F.array(*names)), score))
    rows = rows.withColumn("nary", nary).withColumn("size", sum((F.size(b) for b in names[1:]), F.size(names[0])))
    violated = F.lit(False)
    for order in permutations(range(n)):
        got = E.decision_text(E.winners(E.fold([names[i] for i in order], score, representation), score))
        violated = violated | (got != F.col("nary"))
    return rows.withColumn("violated", violated)


#: Both scores are sums over a value's items: bits of a level's unit. 1: weights 1, 2, 4, 8;
#: 4: counts of each level side by side, the highest level first, which orders like sorted level lists.
_BITS = {"egalitarian": 1, "elitist": 4}


def _unit(level: str) -> str:
    return f"if({level} = 0, 0L, shiftleft(1L, cast(bits * ({level} - 1) as int)))"


def folded(spark: SparkSession, space: str, well_formed: bool) -> DataFrame:
    """One row for each profile, score, representation and order: size, nary and got (bit masks of the best values).

    The same folds as ``violations`` on numbers instead of states: a value's
    state is the sum and the maximum of its levels, which is all that the
    scores and the representations look at.
    """
    values, levels, n = SPACES[space]
    t = n_templates(values, levels, well_formed)
    base = len(levels) + 1
    rows = spark.range(t**n, numPartitions=max(1, min(64, t**n // 400))).withColumnRenamed("id", "profile_id")
    vs, bs = range(len(values)), range(n)
    digits = []
    for k in bs:
        template = f"(profile_id div {t ** (n - 1 - k)} % {t})"
        for v in vs:
            if well_formed:
                level = f"if({template} > 0 and ({template} - 1) div {len(levels)} = {v}, ({template} - 1) % {len(levels)} + 1, 0)"
            else:
                level = f"({template} div {base ** (len(values) - 1 - v)} % {base})"
            table = " ".join(f"when {i + 1} then {e}" for i, e in enumerate(levels))
            digits.append(f"case {level} {table} else 0 end as d{k}_{v}")
    rows = rows.selectExpr("profile_id", *digits)
    size = " + ".join(f"cast(d{k}_{v} > 0 as int)" for k in bs for v in vs)
    orders = ", ".join("array(" + ", ".join(map(str, o)) + ")" for o in permutations(bs))
    scores = ", ".join(f"named_struct('score', '{name}', 'bits', {bits})" for name, bits in _BITS.items())
    keeps = ", ".join(f"'{r}'" for r in E.REPRESENTATIONS)
    carried = [f"d{k}_{v}" for k in bs for v in vs]
    rows = rows.selectExpr("profile_id", f"{size} as size", *carried, f"explode(array({orders})) as o").selectExpr("profile_id", "size", *carried, "o", f"explode(array({scores})) as s")
    rows = rows.selectExpr("profile_id", "size", *carried, "o", "s.score", "s.bits", f"explode(array({keeps})) as representation")
    at = [f"case o[{k}] " + " ".join(f"when {b} then d{b}_{v}" for b in bs) + f" end as x{k}_{v}" for k in bs for v in vs]
    keys = ["profile_id", "size", "score", "bits", "representation"]
    x = [f"x{k}_{v}" for k in bs for v in vs]
    rows = rows.selectExpr(*keys, *at)
    total = {v: " + ".join(_unit(f"x{k}_{v}") for k in bs) for v in vs}
    rows = rows.selectExpr(*keys, *x, *[f"{total[v]} as n{v}" for v in vs], *[f"{_unit(f'x0_{v}')} as s{v}" for v in vs], *[f"x0_{v} as m{v}" for v in vs])
    held = [*x, *[f"n{v}" for v in vs]]
    for k in bs[1:]:
        rows = rows.selectExpr(*keys, *held, *[f"s{v} + {_unit(f'x{k}_{v}')} as s{v}" for v in vs], *[f"greatest(m{v}, x{k}_{v}) as m{v}" for v in vs])
        rows = rows.selectExpr("*", "greatest(" + ", ".join(f"s{v}" for v in vs) + ") as best")
        gone = {v: f"representation <> 'JOIN' and s{v} < best" for v in vs}
        rows = rows.selectExpr(*keys, *held, *[f"if({gone[v]}, 0L, if(representation = 'MAX', {_unit(f'm{v}')}, s{v})) as s{v}" for v in vs], *[f"if({gone[v]}, 0, m{v}) as m{v}" for v in vs])

    def mask(c: str) -> str:
        top = "greatest(" + ", ".join(f"{c}{v}" for v in vs) + ")"
        return " + ".join(f"if({c}{v} > 0 and {c}{v} = {top}, {1 << v}, 0)" for v in vs)

    return rows.selectExpr(f"'{space}' as space", f"{str(well_formed).lower()} as well_formed", "profile_id", "size", "score", "representation", f"{mask('n')} as nary", f"{mask('s')} as got")


def _judged(spark: SparkSession, spaces: list[tuple[str, bool]]) -> DataFrame:
    """(space, well_formed, score, representation, profile_id, size, violated) of every profile."""
    out = None
    for space, well_formed in spaces:
        rows = folded(spark, space, well_formed)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("space", "well_formed", "score", "representation", "profile_id").agg(F.first("size").alias("size"), F.max(F.col("got") != F.col("nary")).alias("violated"))


def failure_rates(spark: SparkSession) -> DataFrame:
    """(space, score, representation, well_formed, failures, total): 24 rows."""
    rows = _judged(spark, [(s, w) for s in SPACES for w in (False, True)])
    return rows.groupBy("space", "score", "representation", "well_formed").agg(F.count_if("violated").alias("failures"), F.count("*").alias("total"))


def smallest_witnesses(spark: SparkSession, limit: int = 1) -> DataFrame:
    """The violated profiles of fewest assertions of each lossy configuration of a space's general form, ties by id."""
    from pyspark.sql import Window

    rows = _judged(spark, [(s, False) for s in SPACES]).where("violated")
    w = Window.partitionBy("space", "score", "representation").orderBy("size", "profile_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def idempotence(spark: SparkSession) -> DataFrame:
    """(score, representation, decision_fails, state_fails, total) of merging a branch with itself, over single branches of both spaces."""
    out = None
    for score in E.SCORES:
        for name, keep in E.REPRESENTATIONS.items():
            for space, (values, levels, _) in SPACES.items():
                t = n_templates(values, levels, False)
                b = branch_state(F.col("id"), "b0", values, levels, False)
                rows = spark.range(t).select(b.alias("b"))
                merged = keep(F.array_union("b", "b"), score)
                same = F.array_sort(merged) == F.array_sort(F.col("b"))
                decided = E.decision_text(E.winners(merged, score)) == E.decision_text(E.winners(F.col("b"), score))
                per = rows.agg(F.count_if(~decided).alias("decision_fails"), F.count_if(~same).alias("state_fails"), F.count("*").alias("total"))
                per = per.select(F.lit(space).alias("space"), F.lit(score).alias("score"), F.lit(name).alias("representation"), "decision_fails", "state_fails", "total")
                out = per if out is None else out.unionByName(per)
    return out


def order_dependence(spark: SparkSession) -> DataFrame:
    """(space, score, representation, well_formed, dependent, total): profiles of which two orders of folding disagree with each other."""
    out = None
    for space in SPACES:
        for well_formed in (False, True):
            rows = folded(spark, space, well_formed)
            out = rows if out is None else out.unionByName(rows)
    per = out.groupBy("space", "well_formed", "score", "representation", "profile_id").agg((F.min("got") != F.max("got")).alias("differs"))
    return per.groupBy("space", "score", "representation", "well_formed").agg(F.count_if("differs").alias("dependent"), F.count("*").alias("total"))


def compounded(spark: SparkSession, claims: int = 2, levels: tuple[int, ...] = (1, 2), n: int = 3, premises: tuple[tuple[int, ...], ...] | None = None, samples: int | None = None, seed: int = 0) -> DataFrame:
    """(representation, profile_id, cost, nary_in, got_in): folds that change which claims of a premise graph are in.

    premises: for each claim those it rests on, all of them; without it the
    claims are a chain, claim 0 an axiom. A claim is in when it is resolved to
    assert and its premises are in: the least fixed point, so a cycle is out. A
    branch says about each claim nothing, assert or refute at a level. Scores
    are egalitarian; the in sets are bit masks; one row for each profile of
    which some order differs. samples: that many profiles drawn by hashes of
    the seed, repeated ones once, instead of all.
    """
    premises = premises or tuple((c - 1,) if c else () for c in range(claims))
    if len(premises) != claims:
        raise ValueError("premises must name those of every claim")
    if n < 3:
        raise ValueError("folding fewer than three branches never differs from merging them at once")
    per = 1 + 2 * len(levels)
    total = per ** (claims * n)
    if samples is None:
        rows = spark.range(total, numPartitions=max(1, min(64, total // 2000))).withColumnRenamed("id", "profile_id")
    else:
        drawn = spark.range(samples, numPartitions=max(1, min(64, samples // 2000)))
        rows = drawn.select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("profile_id")).distinct()
    cells = [(k, c) for k in range(n) for c in range(claims)]
    table = " ".join(f"when {i} then {e}" for i, e in enumerate(levels))
    digit = {cell: f"(profile_id div {per ** (len(cells) - 1 - i)} % {per})" for i, cell in enumerate(cells)}
    said = []
    for (k, c), d in digit.items():  # options: nothing, assert by level, refute by level
        said += [f"if({d} between 1 and {len(levels)}, case {d} - 1 {table} end, 0) as a{k}_{c}", f"if({d} > {len(levels)}, case {d} - 1 - {len(levels)} {table} end, 0) as r{k}_{c}"]
    names = [f"{v}{k}_{c}" for v in "ar" for k, c in cells]
    orders = ", ".join("array(" + ", ".join(map(str, o)) + ")" for o in permutations(range(n)))
    keeps = ", ".join(f"'{r}'" for r in E.REPRESENTATIONS)
    cost = " + ".join(f"cast(a{k}_{c} + r{k}_{c} > 0 as int)" for k, c in cells)
    rows = rows.selectExpr("profile_id", *said).selectExpr("*", f"{cost} as cost", "1 as bits", f"explode(array({orders})) as o").selectExpr("*", f"explode(array({keeps})) as representation")
    at = [f"case o[{k}] " + " ".join(f"when {b} then {v}{b}_{c}" for b in range(n)) + f" end as {v}x{k}_{c}" for v in "ar" for k, c in cells]
    keys = ["profile_id", "cost", "bits", "representation"]
    x = [f"{v}x{k}_{c}" for v in "ar" for k, c in cells]
    rows = rows.selectExpr(*keys, *at)
    span = range(claims)
    rows = rows.selectExpr(*keys, *x, *[f"{' + '.join(_unit(f'{v}x{k}_{c}') for k in range(n))} as {v}n_{c}" for v in "ar" for c in span], *[f"{_unit(f'{v}x0_{c}')} as {v}s_{c}" for v in "ar" for c in span], *[f"{v}x0_{c} as {v}m_{c}" for v in "ar" for c in span])
    held = [*x, *[f"{v}n_{c}" for v in "ar" for c in span]]
    for k in range(1, n):
        rows = rows.selectExpr(*keys, *held, *[f"{v}s_{c} + {_unit(f'{v}x{k}_{c}')} as {v}s_{c}" for v in "ar" for c in span], *[f"greatest({v}m_{c}, {v}x{k}_{c}) as {v}m_{c}" for v in "ar" for c in span])
        lost = lambda v, c: f"representation <> 'JOIN' and {v}s_{c} < {'r' if v == 'a' else 'a'}s_{c}"
        rows = rows.selectExpr(*keys, *held, *[f"if({lost(v, c)}, 0L, if(representation = 'MAX', {_unit(f'{v}m_{c}')}, {v}s_{c})) as {v}s_{c}" for v in "ar" for c in span], *[f"if({lost(v, c)}, 0, {v}m_{c}) as {v}m_{c}" for v in "ar" for c in span])

    def mask(kind: str, known: str) -> str:
        needs = [sum(1 << p for p in set(ps)) for ps in premises]
        return " + ".join(f"if(a{kind}_{c} > r{kind}_{c} and ({known} & {needs[c]}) = {needs[c]}, {1 << c}, 0)" for c in span)

    rows = rows.selectExpr("*", "0 as nary_in", "0 as got_in")
    for _ in span:  # as many rounds as claims reach the fixed point
        rows = rows.selectExpr(*[c for c in rows.columns if c not in ("nary_in", "got_in")], f"{mask('n', 'nary_in')} as nary_in", f"{mask('s', 'got_in')} as got_in")
    found = rows.where("nary_in <> got_in")
    return found.groupBy("representation", "profile_id").agg(F.first("cost").alias("cost"), F.first("nary_in").alias("nary_in"), F.min("got_in").alias("got_in"))
