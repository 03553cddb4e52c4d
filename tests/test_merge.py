"""Premises, trust, packing, rendering, models, sessions, streams."""

import json
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from concordia.functions import text as T
from concordia.operators import derive as D
from concordia.operators import models as M
from concordia.operators import pack as P
from concordia.operators import sessions as S
from concordia.plans import bench as B
from concordia.plans import merge as G
from concordia.sources.logs import Selection
from concordia.streaming import claims as ST

SLOTS = "merge_group long, key string, asserted boolean, routes array<array<string>>"


def derived(spark, rows, by_joins=False):
    slots = spark.createDataFrame([(1, *r) for r in rows], SLOTS)
    if by_joins:
        return {r.key for r in D.admitted_by_joins(slots, ["merge_group"]).collect()}
    return {r.key: (r.status, list(r.unmet)) for r in D.derive(slots, ["merge_group"]).collect()}


CASES = [
    ([("a", True, []), ("b", True, [["a", "c"]]), ("c", True, [])], {"a", "b", "c"}),
    ([("a", True, []), ("b", True, [["a", "c"], ["d"]]), ("d", True, [])], {"a", "b", "d"}),
    ([("a", False, []), ("b", True, [["a"]])], set()),
    ([("a", True, []), ("b", True, [["a"]]), ("c", True, [["b"]]), ("d", True, [["c"]])], {"a", "b", "c", "d"}),
    ([("a", True, [["b"]]), ("b", True, [["a"]])], set()),
    ([("a", True, [["b"], ["r"]]), ("b", True, [["a"]]), ("r", True, [])], {"a", "b", "r"}),
    ([("a", True, [["ghost"]])], set()),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_fixed_point_in_a_row_and_by_joins(spark, case):
    rows, want = CASES[case]
    got = derived(spark, rows)
    assert {k for k, (s, _) in got.items() if s in ("axiom", "founded")} == want
    assert derived(spark, rows, by_joins=True) == want


def test_unmet_premises_are_sorted(spark):
    assert derived(spark, [("a", True, [["z"], ["c", "b"]])])["a"] == ("retracted", ["b", "c", "z"])
    assert derived(spark, [("a", False, [])])["a"][0] == "unasserted"


def test_routes(spark):
    row = spark.range(1).select(
        D.conjunction(F.array(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("c"))).alias("one"),
        D.distinct_routes(F.array(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))).alias("few"),
    ).first()
    assert row.one == [["a", "c"]] and row.few == [["b", "a"], ["c"]]


def test_trust_rules(spark):
    claims = spark.createDataFrame([(1, "a", "v", 2), (1, "a", "w", 1), (1, "p", "v", 0), (1, "b", "v", None)], "merge_group long, key string, value string, trust int")
    slots = spark.createDataFrame([(1, "a", ["v"], [["p"]]), (1, "p", ["v"], []), (1, "b", ["v"], []), (1, "c", ["z"], [])], "merge_group long, key string, values array<string>, routes array<array<string>>")
    assert {(r.key, r.rule) for r in D.trust_violations(claims, slots, ["merge_group"]).collect()} == {("a", "derivation-ceiling"), ("b", "unlabelled"), ("c", "unsupported")}
    assert {r.key: r.trust for r in D.slot_trust(claims, slots, ["merge_group", "key"]).collect()} == {"a": 2, "p": 0, "b": 0, "c": 0}


def some_slots(n):
    kinds = ["Fact", "Decision", "Goal"]
    return P.Slots([f"k{i:02}" for i in range(n)], [kinds[i % 3] for i in range(n)], [5 + (i * 7) % 11 for i in range(n)], [1.0 + (i * 5) % 9 for i in range(n)])


def test_utility_is_monotone_and_submodular():
    s = some_slots(5)
    sets = [c for k in range(6) for c in combinations(range(5), k)]
    for a in sets:
        for b in sets:
            if set(a) <= set(b):
                assert P.set_utility(s, list(b)) >= P.set_utility(s, list(a)) - 1e-12
                for x in set(range(5)) - set(b):
                    gain_a = P.set_utility(s, [*a, x]) - P.set_utility(s, list(a))
                    gain_b = P.set_utility(s, [*b, x]) - P.set_utility(s, list(b))
                    assert gain_a >= gain_b - 1e-9


def test_packing_keeps_to_the_budget_and_seeds_never_hurt():
    for budget in (10, 25, 60):
        s = some_slots(12)
        greedy, _ = P.pack(s, budget, "density")
        seeded, how = P.pack(s, budget, "partial")
        assert sum(s.cost[i] for i in seeded) <= budget
        assert P.set_utility(s, seeded) >= P.set_utility(s, greedy)
        assert how in ("density", "partial")
    equal = P.Slots(["b", "a"], ["Fact", "Fact"], [40, 40], [1.0, 1.0])
    assert P.pack(equal, 45)[0] == [1]
    assert P.pack(equal, 5)[0] == []
    assert len(P.pack(P.Slots([f"k{i}" for i in range(20)], ["Fact"] * 20, [30] * 20, [1.0] * 20), 150)[0]) == 5


def test_coverage_gain_falls():
    assert P.coverage_gain("Goal", 0) > P.coverage_gain("Goal", 1) > P.coverage_gain("Goal", 2) > 0


def surfaces(spark):
    rows = [(1, "a", 0, "user", None, [("text", "The database is PostgreSQL.")]), (1, "b", 0, "assistant", None, [("reasoning", "Probably MySQL.")])]
    return spark.createDataFrame(rows, "merge_group long, session_id string, seq long, role string, source_kind string, blocks array<struct<type:string,text:string>>")


def answer(*slots):
    return json.dumps({"slots": list(slots)})


ENGINE = {"key": "db.engine", "type": "Fact", "opinions": [{"source": "a", "value": "postgresql", "evidence": 4, "quote": "PG"}, {"source": "b", "value": "mysql", "evidence": 1, "quote": "My"}]}


def test_alignment_brings_branches_into_one_slot(spark):
    derived_slot = {"key": "latency", "type": "Decision", "derivedFrom": ["db.engine", "ghost"], "opinions": [{"source": "a", "value": "high", "evidence": 2}]}
    got = G.merge_aligned(surfaces(spark), lambda system, prompt, n: answer(ENGINE, derived_slot)).first()
    assert "`db.engine` = **postgresql**" in got.text and "RETRACTED" in got.text and "ghost" in got.text
    assert "UNTRUSTED BACKGROUND" in got.text and got.included == 2


def test_without_a_usable_answer_sentences_are_merged(spark):
    def broken(*_):
        raise RuntimeError("no model")

    for model in (broken, lambda *_: "no json", lambda *_: '{"slots": []}'):
        assert "the database is postgresql" in G.merge_aligned(surfaces(spark), model).first().text


def test_ties_are_settled_only_if_both_orders_agree(spark):
    tied = {"key": "k", "type": "Fact", "opinions": [{"source": "a", "value": "x", "evidence": 2}, {"source": "b", "value": "y", "evidence": 2}]}

    def model(second):
        asked = []

        def f(system, prompt, n):
            if "CONFLICT" not in prompt:
                return answer(tied)
            asked.append(prompt)
            return json.dumps({"resolutions": [{"key": "k", "outcome": "choose", "value": "x" if len(asked) == 1 else second}]})

        return f

    assert "`k` = **x**" in G.merge_aligned(surfaces(spark), model("x")).first().text
    assert "**DISPUTED** `k`" in G.merge_aligned(surfaces(spark), model("y")).first().text
    assert "**DISPUTED** `k`" in G.merge_aligned(surfaces(spark), model("invented")).first().text


def test_rejected_settlements(spark):
    options = spark.createDataFrame([(1, "k", "a"), (1, "k", "B"), (1, "c", "a")], "merge_group long, key string, value string")
    rows = [
        {"key": "k", "outcome": "choose", "value": "B"}, {"key": "zz", "outcome": "both"}, {"key": "k", "outcome": "maybe"}, {"key": "c", "outcome": "conditional", "guard": " "},
        {"key": "k", "outcome": "choose", "value": " A "}, {"key": "k", "outcome": "both"},
    ]
    good, bad = M.parse_settlements(spark.createDataFrame([(1, json.dumps({"resolutions": rows}))], "merge_group long, answer string"), options)
    assert [(r.key, r.outcome, r.value) for r in good.collect()] == [("k", "choose", "a")]
    assert {r.reason: r.n for r in bad.collect()} == {"invented-value": 1, "unknown-key": 1, "bad-outcome": 1, "missing-guard": 1, "duplicate": 1}


def test_a_budget_below_the_banner_gives_nothing(spark):
    got = G.merge_sessions(surfaces(spark), budget=40).first()
    assert (got.text, got.included, got.dropped, got.reason) == ("", 0, 2, "budget-below-mandatory-overhead")


def test_credentials_never_reach_the_block(spark):
    key = "sk" + "-" + "Ab3dEf6hJk" * 3
    rows = [(1, "a", 0, "user", None, [("text", f"密钥{key} is the key.")])]
    m = spark.createDataFrame(rows, "merge_group long, session_id string, seq long, role string, source_kind string, blocks array<struct<type:string,text:string>>")
    text = G.merge_sessions(m).first().text
    assert key not in text and "REDACTED" in text and "1 credentials withheld" in text


def test_selection(tmp_path):
    s = Selection(str(tmp_path / "x" / "s.json"), ["d"])
    assert s.get() == ["d"]
    s.set([])
    assert Selection(s.path, ["d"]).get() == []
    s.add(["a", "b", "a"])
    s.remove(["b"])
    assert Selection(s.path, ["d"]).get() == ["a"]
    s.clear()
    assert Selection(s.path, ["d"]).get() == ["d"]
    s.path.write_text("{broken")
    assert Selection(s.path, ["d"]).get() == ["d"]


def test_ranking_is_stable_and_picking_knows_three_ways(spark):
    rows = [("abc", "T", 5, 1, 0), ("abd", "U", None, 1, 1), ("12", None, 5, 1, 2), ("x", "V", 9, 1, 3)]
    c = spark.createDataFrame([(i, t, m, b, None, o) for i, t, m, b, o in rows], "id string, title string, mtime long, bytes long, workspace string, input_ord long")
    ranked = S.rank(c, limit=None)
    assert [r.id for r in ranked.orderBy("position").collect()] == ["x", "abc", "12", "abd"]
    tokens = spark.createDataFrame(list(enumerate(["12", "1", "ab", "abc", "x", "9", "q"])), "token_ord long, token string")
    got = {r.token: (r.id, r.error) for r in S.resolve(tokens, ranked).collect()}
    assert got["12"][0] == "12" and got["1"][0] == "x" and got["abc"][0] == "abc" and got["x"][0] == "x"
    assert got["ab"][1] == "ab begins 2 ids" and got["9"][1] == "there is no number 9 among 4 sessions" and got["q"][1] == "no id begins with q"


def test_stream_windows_and_order(spark, sf):
    events = ST.read_table(spark, sf, "events")
    op = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.lit("s").alias("source"), F.lit(1).alias("evidence"), F.col("ts").cast("timestamp").alias("ts"))
    out = ST.run_to_end(ST.windowed_decisions(op, "ts", "1 hour", "1 day", ["key"]), "windows_test", "append")
    # against the batch definition of the same windows, which knows no watermark: final windows are all there and alike
    batch = spark.read.parquet(f"{sf}/events.parquet")
    rows = batch.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.lit("s").alias("source"), F.lit(1).alias("evidence"), F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("window_start"))
    from concordia.operators import slots as O

    want = {(r.window_start, r.key): (r.outcome, r.winner, tuple(r.tied or [])) for r in O.decide(O.items(rows, ["window_start", "key"]), ["window_start", "key"]).collect()}
    got = {(r.window_start, r.key): (r.outcome, r.winner, tuple(r.tied or [])) for r in out.collect()}
    last = max(w for w, _ in want)
    assert all(want[k] == v for k, v in got.items()) and {w for w, _ in got} >= {w for w, _ in want if (last - w).days > 2}


def test_order_matters_to_collapsed_folds_only(spark):
    make = lambda *rows: spark.createDataFrame(rows, "key string, value string, source string, evidence int")
    batches = [make(("k", "a", "x", 1)), make(("k", "a", "y", 1)), make(("k", "b", "z", 2))]
    run = lambda order, keep: ST.fold_in_arrival_order([batches[i] for i in order], ["key"], keep).first()["decision"]
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    assert {run(o, "JOIN") for o in orders} == {"disputed:a,b"}
    assert len({run(o, "MAX") for o in orders}) > 1 or {run(o, "MAX") for o in orders} == {"resolved:b"}


def test_premises_may_be_alternatives(spark):
    given = [(1, ["a", "b"]), (2, ['["a","b"]', "c"]), (3, []), (4, None), (5, ['[]', ""]), (6, ['["x",""]'])]
    got = {r.i: r.r for r in spark.createDataFrame(given, "i int, p array<string>").select("i", D.routes_of(F.col("p")).alias("r")).collect()}
    assert got == {1: [["a", "b"]], 2: [["a", "b"], ["c"]], 3: [], 4: [], 5: [], 6: [["x"]]}


def test_the_three_layouts_are_one(spark, tmp_path):
    from concordia.sources import logs as L

    block = [("text", "hello")]
    one = spark.createDataFrame([("s", 0, "user", block)], f"session_id string, seq bigint, role string, blocks {L.BLOCKS}")
    two = spark.createDataFrame([("s", [("user", block)])], f"session_id string, messages array<struct<role:string,blocks:{L.BLOCKS}>>")
    three = spark.createDataFrame([("s", [("user/message", (None, block, (None,)))])], f"session_id string, events array<struct<event_type:string,data:struct<role:string,content:{L.BLOCKS},source:struct<kind:string>>>>")
    rows = [[tuple(r) for r in L.to_messages(x).collect()] for x in (one, two, three)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 1
    good = tmp_path / "good.json"
    good.write_text('{"session_id":"s","seq":1,"event_type":"user/message","data":{"content":[{"type":"text","text":"x"}]}}\nbroken\n')
    assert L.read_events(spark, str(good), str(tmp_path / "none.json")).where("session_id is not null").count() == 1
    assert [r.line for r in L.quarantined(spark, str(good), str(tmp_path / "none.json")).collect()] == ["broken"]
    assert L.read_events(spark, str(tmp_path / "none.json")).count() == 0
    L.write_results(one.select("session_id"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_credentials_are_gated_not_missed(spark):
    from concordia import registry

    texts = [*registry._credential_literals(), "plain words: nothing here", "the password is long", "", None, "API KEY: " + "Z" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    whole = F.col("t")
    for kind, pattern in T.CREDENTIALS:
        whole = F.regexp_replace(whole, T._bounded(pattern), f"[REDACTED:{kind}]")
    whole = F.regexp_replace(whole, T._LABELLED, "$1[REDACTED:labelled]$3")
    for r in rows.select("t", T.redact(F.col("t")).alias("a"), whole.alias("b"), T.has_credentials(F.col("t")).alias("has"), T.redactions(F.col("t")).alias("n")).collect():
        assert r.a == r.b
        if r.t is not None:
            assert r.has == (r.a != r.t) == (r.n > 0)


def test_a_cut_counts_utf16_units(spark):
    text = "ab" + "\U0001F600" * 4 + "cd"
    got = {n: spark.range(1).select(T.utf16_tail(F.lit(text), n)).first()[0] for n in (2, 3, 4, 9, 10, 12, 50)}
    face = "\U0001F600"
    assert got == {2: "cd", 3: "cd", 4: face + "cd", 9: face * 3 + "cd", 10: face * 4 + "cd", 12: text, 50: text}


def test_the_step_refuses_what_trust_cannot_vouch_for(spark):
    def say(group, session, text, own=False):
        return (group, session, 1, "user", None, [("text", text)], own)

    rows = [say("g", "a", "The database is postgres. Deploys need approval."), say("g", "b", "The database is not postgres."), say("h", "c", "password: " + "Q7" * 10), say("h", "me", "What about the password?", True), say("e", "d", "   ")]
    messages = spark.createDataFrame(rows, "merge_group string, session_id string, seq bigint, role string, source_kind string, blocks array<struct<type:string,text:string>>, own boolean")
    got = {r.merge_group: r for r in G.apply_step(messages, for_query=True, algorithm="density").collect()}
    assert set(got) == {"g", "h"} and got["g"].injected and not got["g"].refused and got["g"].redacted == 0 and got["h"].redacted == 1
    assert "[REDACTED:labelled]" in got["h"].text and "Q7Q7" not in got["h"].text and "1 credentials withheld" in got["h"].text and "What about" not in got["h"].text
    assert got["g"]["mode"] == "heuristic" and got["g"].adjudication == "skipped" and got["g"].conflicts == 1
    merged = G.heuristic(messages.where("merge_group = 'g'").drop("own"))
    merged.claims = merged.claims.withColumn("trust", F.lit(None).cast("int"))
    bad = G.guarded(merged, algorithm="density").first()
    assert bad.refused and not bad.injected and bad.text == "" and bad.reason == "trust" and bad.violations > 0


def test_draws_stand_alone():
    r = B.Draws(7)
    assert [r.next() for _ in range(5)] == [B.draw(7, n) for n in range(1, 6)]
    s = B.scenario(1, topics=10)
    assert len([f for f in s.facts if f[5]]) == 10 and len([f for f in s.facts if not f[5]]) == 2
    with pytest.raises(ValueError, match="two branches"):
        B.scenario(1, branches=1)


def test_what_each_branch_covers_alone(spark):
    rows = B.branch_coverage(spark, range(1, 4), branches=3, topics=10).collect()
    by = {}
    for r in rows:
        by.setdefault(r.seed, []).append(r)
    assert set(by) == {1, 2, 3} and all(len(x) == 3 for x in by.values())
    for x in by.values():
        rates = [r.overall for r in x]
        assert all(abs(r.best - max(rates)) < 1e-9 and abs(r["mean"] - sum(rates) / 3) < 1e-9 for r in x) and 0 < max(rates) < 1
    scored = B.score(spark, [1], budget=1200)
    up = {r.arm: r for r in B.rollup(scored).collect()}
    assert up["oracle"].conflicts == 2 and up["none"].tokens == 0 and up["concat"].tokens_per_question > 0


def test_controls(spark, tmp_path):
    c = spark.createDataFrame([("abc", "T", 5, 10, None, 0), ("abd", "U", 3, 10, None, 1), ("me", "V", 9, 10, None, 2)], "id string, title string, mtime long, bytes long, workspace string, input_ord long")
    s = Selection(str(tmp_path / "s.json"), ["old"])
    do = lambda raw: S.control(c, s, *S.parse_command(raw), own="me")
    assert do("")[1].count("\n") == 1 and "me " not in do("list")[1]
    assert do("abc") == (True, "Sources merged: abc.") and s.get() == ["abc"]
    assert do("add 2 ab")[0] is False and s.get() == ["abc"]
    assert do("add 2")[0] and s.get() == ["abc", "abd"]
    assert do("rm abc")[0] and s.get() == ["abd"]
    assert do("set")[0] is False
    assert do("off")[0] and s.get() == ["old"]
    assert "old" in do("status")[1]
    titled = S.with_titles(c.drop("title"), c.select("id", "title").where("id <> 'me'"))
    assert {r.id: r.title for r in titled.collect()} == {"abc": "T", "abd": "U", "me": None}


def test_compounded_failures(spark):
    from concordia.operators import confluence as X

    found = X.compounded(spark)
    assert found.where("representation = 'JOIN'").count() == 0
    assert found.where("representation = 'MAX'").agg(F.min("cost")).first()[0] == 3
    with pytest.raises(ValueError, match="three branches"):
        X.compounded(spark, n=2)


def _folded_in(profile, premises, levels, representation, order):
    """The claims that are in after a fold, in plain Python: profile[branch][claim] = (value, level) or None."""
    weight = lambda items: sum(1 << (e - 1) for _, e in items)
    state = {}
    for c in range(len(premises)):
        held: dict[str, set] = {"a": set(), "r": set()}
        for k, b in enumerate(order):
            if profile[b][c]:
                v, e = profile[b][c]
                held[v].add((b, e))
            if k and representation != "JOIN":
                score = {v: weight(x) for v, x in held.items()}
                top = max(score.values())
                held = {v: (x if representation == "COUNT" else {max(x, key=lambda i: i[1])} if x else x) if score[v] == top else set() for v, x in held.items()}
        state[c] = weight(held["a"]) > weight(held["r"])
    known: set[int] = set()
    for _ in premises:
        known = {c for c, ps in enumerate(premises) if state[c] and set(ps) <= known}
    return sum(1 << c for c in known)


@pytest.mark.parametrize("premises", [((), (0,)), ((), (), (0, 1)), ((1,), (0,)), ((), (0,), (0, 1))])
def test_compounded_failures_of_any_graph(spark, premises):
    from itertools import permutations

    from concordia.operators import confluence as X

    claims, levels = len(premises), (1, 2)
    options = [None, *[("a", e) for e in levels], *[("r", e) for e in levels]]
    found = {(r.representation, r.profile_id): (r.cost, r.nary_in) for r in X.compounded(spark, claims, levels, premises=premises, samples=400, seed=3).collect()}
    total = 5 ** (claims * 3)
    ids = [r[0] for r in spark.range(400).select(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(total))).distinct().collect()]
    want = {}
    for i in ids:
        digits = [i // 5 ** (claims * 3 - 1 - k) % 5 for k in range(claims * 3)]
        profile = [[options[d] for d in digits[b * claims : (b + 1) * claims]] for b in range(3)]
        whole = _folded_in(profile, premises, levels, "JOIN", (0, 1, 2))
        for rep in ("JOIN", "COUNT", "MAX"):
            if any(_folded_in(profile, premises, levels, rep, o) != whole for o in permutations(range(3))):
                want[(rep, i)] = (sum(x is not None for b in profile for x in b), whole)
    assert found == want and not any(rep == "JOIN" for rep, _ in want)


def test_orders_disagree_only_where_folding_fails(spark):
    from concordia.operators import confluence as X

    fails = {(r.space, r.score, r.representation, r.well_formed): r.failures for r in X.failure_rates(spark).collect()}
    rows = X.order_dependence(spark).collect()
    assert len(rows) == 24 and all(r.dependent <= fails[(r.space, r.score, r.representation, r.well_formed)] for r in rows)
    assert all((r.dependent == 0) if r.representation == "JOIN" else True for r in rows) and any(r.dependent for r in rows)


def test_packing_takes_all_parts(spark, sf):
    from concordia import registry

    keys = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().count()
    assert keys == registry.queries()["pack_density"](spark, sf).count() and keys > 0
    parts = spark.createDataFrame([(k, "A", k, 0.0, 1, 1) for k in range(395, 406)], "l_partkey long, l_returnflag string, l_suppkey long, l_quantity double, l_linenumber int, l_orderkey long")
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        parts.write.parquet(f"{d}/lineitem.parquet")
        assert {r.key for r in registry.queries()["pack_partial"](spark, d).collect()} == {str(k) for k in range(395, 406)}


def test_bounded_packing_equals_every_start():
    import random
    from itertools import combinations

    from concordia.operators import pack as P

    for seed in range(30):
        r = random.Random(seed)
        n = r.randint(1, 40)
        s = P.Slots([f"{r.random():.6f}" for _ in range(n)], [r.choice(["Goal", "Fact", "OpenQ"]) for _ in range(n)], [r.randint(3, 12) for _ in range(n)], [r.choice([1.0, 4.5, 9.0, 20.0]) for _ in range(n)])
        budget = r.randint(5, 60)
        fits = [i for i in range(n) if s.cost[i] <= budget]
        best, how = P.by_density(s, budget), "density"
        value = P.set_utility(s, best)
        for start in combinations(fits, min(2, len(fits))):
            if sum(s.cost[i] for i in start) <= budget and (found := P.set_utility(s, got := P.by_density(s, budget, start))) > value:
                best, value, how = got, found, "partial"
        got, name = P.pack(s, budget)
        assert abs(P.set_utility(s, got) - value) < 1e-9
        assert not fits or name == how
