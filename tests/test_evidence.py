"""Slots, folds, text rules and their traps."""

import itertools

import pytest
from pyspark.sql import functions as F

from concordia.functions import evidence as E
from concordia.functions import text as T
from concordia.operators import claims as C
from concordia.operators import confluence as X
from concordia.operators import slots as O
from concordia.registry import _credential_literals


def state(*items):
    return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(s).alias("source"), F.lit(e).alias("evidence")) for v, s, e in items]) if items else F.array().cast(E.STATE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def decide(spark, *items, score="egalitarian"):
    return one(spark, E.decision_text(E.winners(state(*items), score)))


def test_same_source_at_two_levels_counts_twice(spark):
    assert decide(spark, ("a", "s", 1), ("a", "s", 2), ("b", "t", 2)) == "resolved:a"
    rows = spark.createDataFrame([("k", "a", "s", 1), ("k", "a", "s", 2), ("k", "a", "s", 2), ("k", "b", "t", 2)], "key string, value string, source string, evidence int")
    assert [tuple(r)[:3] for r in O.decide(O.items(rows, ["key"]), ["key"]).collect()] == [("k", "resolved", "a")]


@pytest.mark.parametrize(("items", "score", "want"), [
    ((("a", "x", 2), ("b", "y", 2)), "egalitarian", "disputed:a,b"),
    ((("a", "x", 4), ("b", "y", 3), ("b", "z", 3)), "egalitarian", "disputed:a,b"),
    ((("a", "x", 4), ("b", "y", 3), ("b", "z", 3)), "elitist", "resolved:a"),
    ((("a", "x", 2), ("b", "y", 2), ("b", "z", 1)), "elitist", "resolved:b"),
    ((("a", "x", 9), ("b", "y", 1)), "egalitarian", "resolved:b"),
    ((), "egalitarian", "empty"),
])
def test_decisions(spark, items, score, want):
    assert decide(spark, *items, score=score) == want


def test_folding_whole_states_is_order_free_and_collapsing_is_not(spark):
    branches = [state(("a", "b0", 1)), state(("a", "b1", 1)), state(("b", "b2", 2))]
    got = {r: {one(spark, E.decision_text(E.winners(E.fold([branches[i] for i in o], "egalitarian", r)))) for o in itertools.permutations(range(3))} for r in E.REPRESENTATIONS}
    assert got["JOIN"] == {"disputed:a,b"}
    assert got["MAX"] == {"resolved:b"}  # merged at once they are tied


def test_one_branch_is_never_collapsed(spark):
    b = state(("a", "s", 1), ("b", "t", 2))
    assert len(one(spark, E.fold([b], "egalitarian", "MAX"))) == 2


def test_number_folds_agree_with_state_folds(spark):
    for space, well_formed in (("B", True), ("A", True)):
        numbers = {(r.profile_id, r.score, r.representation): r.violated for r in X._judged(spark, [(space, well_formed)]).collect()}
        rows = X.profiles(spark, space, well_formed).where("profile_id % 7 = 3")
        for score in E.SCORES:
            for keep in ("COUNT", "MAX"):
                for r in X.violations(rows, 3, score, keep).select("profile_id", "violated").collect():
                    assert numbers[(r.profile_id, score, keep)] == r.violated


def test_sentences(spark):
    assert one(spark, T.split_sentences(F.lit("One. Two!三。四？ five; 3.14 six"))) == ["One.", "Two!", "三。", "四？", "five;", "3.", "14 six"]
    assert one(spark, T.split_sentences(F.lit(" 　 "))) == []
    assert one(spark, T.split_sentences(F.lit(None).cast("string"))) == []


def test_keys(spark):
    assert one(spark, T.normalise_key(F.lit("The **DB**  is `x_1`,　OK!"))) == "the db is x 1 ok"
    assert one(spark, T.normalise_key(F.lit("b a bb aa bb"), "bag")) == "aa bb bb"


def test_negation_takes_the_first_word_and_the_first_character(spark):
    assert one(spark, T.without_negation(F.lit("it is not no"))) == "it is  no"
    assert one(spark, T.is_negated(F.lit("nothing here"))) is False
    assert one(spark, T.is_negated(F.lit("we do NOT"))) is True
    assert one(spark, T.is_negated(F.lit("非常好"))) is True
    assert one(spark, T.without_negation(F.lit("不是没有"))) == " 是没有"


def test_every_kind_of_credential_goes_also_behind_wide_characters(spark):
    for text in _credential_literals()[:-1]:
        for before in ("", "密钥", "x ", "("):
            got = one(spark, T.redact(F.lit(before + text)))
            assert "[REDACTED:" in got, text[:6]
    assert one(spark, T.redactions(F.lit(_credential_literals()[1]))) == 1
    assert "openai" in one(spark, T.redact(F.lit(_credential_literals()[1])))  # the earlier, broader form names it


def test_what_is_no_credential_stays(spark):
    keep = ["token budget", "the token expired", "a" * 40, "0123456789abcdef" * 2, "api_key = xxxxxxxxxxxxxxxxxxxx", "password: your-password-here-please", "arXiv:2401.12345", "C:/a/b/c/d/e/f/g.txt"]
    for text in keep:
        assert one(spark, T.redact(F.lit(text))) == text
        assert one(spark, T.redactions(F.lit(text))) == 0


def test_lengths_are_in_utf16_units(spark):
    assert one(spark, T.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, T.token_estimate(F.lit("a😀ab"))) == 2


def test_levels_from_json(spark):
    for raw, want in (("4", 4), ("2.5", 3), ("9", 4), ("-1", 1), ('"3"', 3), ("null", 1), ('""', 1), ("true", 1), ("x", 2)):
        assert one(spark, E.clamp_evidence(F.lit(raw))) == want, raw


def test_blocks_roles_and_order(spark):
    rows = [
        ("s", 0, "user", None, [("text", " Hi. "), (None, "No type."), ("image", "x"), ("text", " ")]), ("s", 1, "assistant", None, [("reasoning", "I think.")]),
        ("s", 2, "user", "plugin", [("text", "Injected.")]), ("s", 3, "tool", None, [("text", "Out.")]), ("s", 4, None, None, [("text", "Said.")]),
    ]
    m = spark.createDataFrame(rows, "session_id string, seq long, role string, source_kind string, blocks array<struct<type:string,text:string>>")
    got = [(r.text, r.evidence) for r in C.claims(m).orderBy("claim_ord").collect()]
    assert got == [("Hi.", 4), ("No type.", 4), ("I think.", 1), ("Out.", 3), ("Said.", 2)]
    with_plugin = [(r.text, r.evidence) for r in C.claims(m, injected=True).where("seq = 2").collect()]
    assert with_plugin == [("Injected.", 1)]
    assert C.claims(m, reasoning=False).where("evidence = 1").count() == 0
    assert C.flatten(m).first()["text"].split("\n")[2] == "[reasoning] I think."


def test_negated_and_plain_share_a_slot(spark):
    m = spark.createDataFrame([("a", 0, "user", None, [("text", "We do use X.")]), ("b", 0, "assistant", None, [("reasoning", "We do not use X.")])], "session_id string, seq long, role string, source_kind string, blocks array<struct<type:string,text:string>>")
    c = C.claims(m)
    assert {(r.key, r.value) for r in c.collect()} == {("we do use x", "assert"), ("we do use x", "refute")}
    assert O.decide(O.items(c, ["key"]), ["key"]).first()["winner"] == "assert"
