"""Queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import evidence as E
from .functions import text as T
from .operators import claims as C
from .operators import confluence as X
from .operators import derive as D
from .operators import models as M
from .operators import pack as P
from .operators import render as R
from .operators import sessions as S
from .operators import slots as O
from .plans import bench as B
from .plans import merge as G
from .sources import logs as L
from .streaming import claims as ST

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- opinions --------------------------------------------------------------------


def line_opinions(spark: SparkSession, d: str) -> DataFrame:
    """Each line item is an opinion of its supplier on the return flag of its part."""
    return _read(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("key"), F.col("l_returnflag").alias("value"), F.col("l_suppkey").cast("string").alias("source"), (1 + F.col("l_linenumber") % 4).cast("int").alias("evidence"),
        (F.col("l_suppkey") % 3).cast("int").alias("trust"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_ord"),
    )


_ITEMS = """items AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS k, l_returnflag AS v, CAST(l_suppkey AS VARCHAR) AS s, 1 + l_linenumber % 4 AS e FROM lineitem)"""


def _decide_sql(source: str = "items", score: str = "sum(1 << (e - 1))", key: str = "k") -> str:
    """CTEs sc (score of each key and value) and dec (one row for each key), from rows of key, v, e."""
    return f"""sc AS (SELECT {key}, v, {score} AS score, count(*) AS n FROM {source} GROUP BY {key}, v),
top AS (SELECT *, max(score) OVER (PARTITION BY {key}) AS best, sum(n) OVER (PARTITION BY {key}) AS total FROM sc),
dec AS (SELECT {key}, CASE WHEN count(*) = 1 THEN 'resolved' ELSE 'disputed' END AS outcome, CASE WHEN count(*) = 1 THEN min(v) END AS winner,
  CASE WHEN count(*) > 1 THEN string_agg(v, ',' ORDER BY v) ELSE '' END AS tied_csv, CAST(any_value(total) AS BIGINT) AS n_items FROM top WHERE score = best GROUP BY {key})"""


_ELITIST = "list(e ORDER BY e DESC)"
_DEC_COLS = "outcome, winner, tied_csv, n_items"


def _flat(decided: DataFrame, *keys: str) -> DataFrame:
    return decided.select(*keys, "outcome", "winner", F.array_join("tied", ",").alias("tied_csv"), "n_items")


@query(f"WITH {_ITEMS}, {_decide_sql()} SELECT k AS key, {_DEC_COLS} FROM dec")
def slot_decisions_lineitem(spark, d):
    return _flat(O.decide(O.items(line_opinions(spark, d), ["key"]), ["key"]), "key")


@query(f"WITH {_ITEMS}, {_decide_sql(score=_ELITIST)} SELECT k AS key, {_DEC_COLS} FROM dec")
def slot_decisions_lineitem_elitist(spark, d):
    return _flat(O.decide(O.items(line_opinions(spark, d), ["key"]), ["key"], "elitist"), "key")


@query(f"WITH {_ITEMS}, {_decide_sql()} SELECT k AS key, CASE outcome WHEN 'resolved' THEN 'resolved:' || winner ELSE 'disputed:' || tied_csv END AS decision FROM dec")
def decision_text(spark, d):
    state = O.states(line_opinions(spark, d), ["key"])
    return state.select("key", E.decision_text(E.winners(F.col("state"))).alias("decision"))


@query(f"WITH {_ITEMS} SELECT k AS key, string_agg(v || '/' || s || '/' || e, ' ' ORDER BY v, s, e) AS items, count(*) AS n_items FROM items GROUP BY k")
def slot_state_canonical(spark, d):
    state = O.states(line_opinions(spark, d), ["key"])
    shown = F.transform("state", lambda i: F.concat_ws("/", i["value"], i["source"], i["evidence"].cast("string")))
    return state.select("key", F.array_join(shown, " ").alias("items"), F.size("state").cast("long").alias("n_items"))


@query(f"WITH {_ITEMS} SELECT k AS key, v AS value, count(*) AS n_items, CAST(sum(1 << (e - 1)) AS BIGINT) AS egalitarian, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e DESC) AS elitist, CAST(max(e) AS INTEGER) AS max_evidence FROM items GROUP BY k, v")
def slot_scores(spark, d):
    state = O.items(line_opinions(spark, d), ["key"])
    a = O.scores(state, ["key"]).select("key", "value", "n_items", F.col("score")[0].alias("egalitarian"), "max_evidence")
    b = O.scores(state, ["key"], "elitist").select("key", "value", F.array_join(F.col("score").cast("array<string>"), ",").alias("elitist"))
    return a.join(b, ["key", "value"])


@query(f"""WITH items AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k, event_type AS v, CAST(CAST(ts AS DATE) AS VARCHAR) AS s, 1 + event_id % 4 AS e FROM events), {_decide_sql()} SELECT k AS key, {_DEC_COLS} FROM dec""")
def slot_decisions_events(spark, d):
    e = _read(spark, d, "events")
    op = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.to_date("ts").cast("string").alias("source"), (1 + F.col("event_id") % 4).cast("int").alias("evidence"))
    return _flat(O.decide(O.items(op, ["key"]), ["key"]), "key")


@query(f"WITH {_ITEMS} SELECT k AS key, CAST(max(e) AS INTEGER) AS max_evidence, count(DISTINCT s) AS n_sources FROM items GROUP BY k")
def slot_support(spark, d):
    return O.items(line_opinions(spark, d), ["key"]).groupBy("key").agg(F.max("evidence").alias("max_evidence"), F.countDistinct("source").alias("n_sources"))


# --- folding -----------------------------------------------------------------------


def _folded(spark, d, representation, score="egalitarian"):
    op = line_opinions(spark, d).withColumn("b", F.col("source").cast("long") % 3)
    item = F.struct(F.col("value"), F.col("source"), F.col("evidence"))
    per = op.groupBy("key").agg(*[F.collect_set(F.when(F.col("b") == k, item)).alias(f"b{k}") for k in range(3)])
    folded = per.select("key", E.winners(E.fold([F.col("b0"), F.col("b1"), F.col("b2")], score, representation), score).alias("v"))
    return folded.select("key", E.decision_text(F.col("v")).alias("decision"))


def _fold_sql(representation: str) -> str:
    kept = """SELECT k, v FROM (SELECT k, v, sum(1 << (e - 1)) AS score, max(sum(1 << (e - 1))) OVER (PARTITION BY k) AS best FROM {u} GROUP BY k, v) WHERE score = best"""
    keep = {
        "JOIN": "SELECT * FROM {u}",
        "MAX": "SELECT k, v, '*merged*' AS s, max(e) AS e FROM {u} JOIN (" + kept + ") USING (k, v) GROUP BY k, v",
        "COUNT": "SELECT k, v, '*merged*:' || (row_number() OVER (PARTITION BY k, v ORDER BY e DESC) - 1) AS s, e FROM {u} JOIN (" + kept + ") USING (k, v)",
    }[representation]
    steps = [_ITEMS, "r0 AS (SELECT * FROM items WHERE CAST(s AS BIGINT) % 3 = 0)"]
    for i in (1, 2):
        steps += [f"u{i} AS (SELECT k, v, s, e FROM r{i - 1} UNION SELECT k, v, s, e FROM items WHERE CAST(s AS BIGINT) % 3 = {i})", f"r{i} AS ({keep.format(u=f'u{i}')})"]
    last = kept.format(u="r2")
    return "WITH " + ", ".join(steps) + f" SELECT k AS key, CASE WHEN count(*) = 1 THEN 'resolved:' ELSE 'disputed:' END || string_agg(v, ',' ORDER BY v) AS decision FROM ({last}) GROUP BY k"


@query(_fold_sql("JOIN"))
def fold_join_ordered(spark, d):
    return _folded(spark, d, "JOIN")


@query(_fold_sql("MAX"))
def fold_max_ordered(spark, d):
    return _folded(spark, d, "MAX")


@query(_fold_sql("COUNT"))
def fold_count_ordered(spark, d):
    return _folded(spark, d, "COUNT")


# Failures of each lossy configuration; folding whole states never fails.
_TOTALS = {("A", False): 19683, ("A", True): 343, ("B", False): 15625, ("B", True): 729}
_FAILURES = {
    ("A", "egalitarian", "COUNT", False): 7740, ("A", "egalitarian", "MAX", False): 8034, ("A", "elitist", "COUNT", False): 7794, ("A", "elitist", "MAX", False): 7620,
    ("A", "egalitarian", "COUNT", True): 54, ("A", "egalitarian", "MAX", True): 90, ("A", "elitist", "COUNT", True): 36, ("A", "elitist", "MAX", True): 72,
    ("B", "egalitarian", "COUNT", False): 4488, ("B", "egalitarian", "MAX", False): 3594, ("B", "elitist", "COUNT", False): 3276, ("B", "elitist", "MAX", False): 3240,
    ("B", "egalitarian", "COUNT", True): 90, ("B", "egalitarian", "MAX", True): 114, ("B", "elitist", "COUNT", True): 72, ("B", "elitist", "MAX", True): 96,
}
_RATES = ", ".join(
    f"('{s}', '{sc}', '{r}', {str(w).lower()}, CAST({_FAILURES.get((s, sc, r, w), 0)} AS BIGINT), CAST({_TOTALS[s, w]} AS BIGINT))" for s in "AB" for sc in E.SCORES for r in E.REPRESENTATIONS for w in (False, True)
)


@query(f"SELECT * FROM (VALUES {_RATES}) AS t(space, score, representation, well_formed, failures, total)")
def confluence_rates(spark, d):
    return X.failure_rates(spark)


@query("SELECT space, score, representation, CAST(3 AS INTEGER) AS size FROM (VALUES ('A'), ('B')) AS a(space), (VALUES ('egalitarian'), ('elitist')) AS b(score), (VALUES ('COUNT'), ('MAX')) AS c(representation)")
def smallest_witnesses(spark, d):
    return X.smallest_witnesses(spark).select("space", "score", "representation", "size")


@query("""SELECT space, score, representation, CAST(0 AS BIGINT) AS decision_fails, representation <> 'JOIN' AS state_changes FROM (VALUES ('A'), ('B')) AS a(space), (VALUES ('egalitarian'), ('elitist')) AS b(score), (VALUES ('JOIN'), ('COUNT'), ('MAX')) AS c(representation)""")
def idempotence(spark, d):
    return X.idempotence(spark).select("space", "score", "representation", "decision_fails", (F.col("state_fails") > 0).alias("state_changes"))


@query("SELECT 'MAX' AS representation, CAST(3 AS INTEGER) AS least_cost, true AS found")
def compounded_failures(spark, d):
    found = X.compounded(spark).where("representation = 'MAX'")
    return found.groupBy("representation").agg(F.min("cost").cast("int").alias("least_cost"), (F.count("*") > 0).alias("found"))


# --- text ----------------------------------------------------------------------------

_NEG = "(^|\\s)(" + "|".join(w.replace("'", "''") for w in T.NEGATING_WORDS) + ")\\b"
_ZH = f"[{T.NEGATING_CHARACTERS}]"
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_SENTENCES = (
    "sent AS (SELECT conv_id, turn, role, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM (SELECT *, string_split(regexp_replace(text, '([.!?。！？；;])\\s*', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations)), "
    "s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS sentence_idx, x AS sentence FROM (SELECT *, " + _TRIM.format(x="raw") + " AS x FROM sent) WHERE length(x) > 0)"
)


def _norm_sql(x: str) -> str:
    return _TRIM.format(x=f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[`*_#>\\[\\]()]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')".replace("{{", "{").replace("}}", "}"))


_BARE = f"regexp_replace(regexp_replace(sentence, '(?i){_NEG}', ' '), '{_ZH}', ' ')"
_NEGATED = f"(regexp_matches(sentence, '(?i){_NEG}') OR regexp_matches(sentence, '{_ZH}'))"
_LEVEL = "CASE role WHEN 'user' THEN 4 WHEN 'tool' THEN 3 ELSE 2 END"
_CLAIMS = f"{_SENTENCES}, cl AS (SELECT conv_id, turn, sentence_idx, {_norm_sql(_BARE)} AS key, CASE WHEN {_NEGATED} THEN 'refute' ELSE 'assert' END AS value, CAST({_LEVEL} AS INTEGER) AS evidence, sentence AS text FROM s)"


def messages(spark, d):
    return L.turns_to_messages(_read(spark, d, "conversations"))


@query(f"WITH {_SENTENCES} SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CAST(sentence_idx AS INTEGER) AS sentence_idx, sentence FROM s")
def sentences(spark, d):
    rows = C.blocks(messages(spark, d))
    return rows.select("session_id", "seq", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_idx", "sentence"))


def _claim_rows(spark, d, strategy):
    rows = C.claims(messages(spark, d), strategy)
    return rows.select("session_id", "seq", F.col("claim_ord.sentence_idx").alias("sentence_idx"), "key", "value", "evidence", "text")


_CLAIM_COLS = "CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CAST(sentence_idx AS INTEGER) AS sentence_idx"


@query(f"WITH {_CLAIMS} SELECT {_CLAIM_COLS}, key, value, evidence, text FROM cl WHERE length(key) > 0")
def claims_exact(spark, d):
    return _claim_rows(spark, d, "exact")


@query(f"WITH {_CLAIMS}, bag AS (SELECT * REPLACE (array_to_string(list_sort(list_filter(string_split(key, ' '), lambda w: length(w) >= 2)), ' ') AS key) FROM cl) SELECT {_CLAIM_COLS}, key, value, evidence, text FROM bag WHERE length(key) > 0")
def claims_bag(spark, d):
    return _claim_rows(spark, d, "bag")


@query(f"""WITH {_CLAIMS}, items AS (SELECT DISTINCT conv_id % 10 AS g, key AS k, value AS v, conv_id AS s, evidence AS e FROM cl WHERE length(key) > 0), {_decide_sql(key="g, k")}
SELECT CAST(g AS BIGINT) AS merge_group, k AS key, {_DEC_COLS} FROM dec""")
def heuristic_merge(spark, d):
    grouped = messages(spark, d).withColumn("merge_group", F.col("session_id").cast("long") % 10)
    return _flat(O.decide(O.items(C.claims(grouped), ["merge_group", "key"]), ["merge_group", "key"]), "merge_group", "key")


@query("SELECT role, CASE role WHEN 'user' THEN 'user' WHEN 'tool' THEN 'tool' ELSE 'assistant' END AS label, CAST(CASE role WHEN 'user' THEN 4 WHEN 'tool' THEN 3 ELSE 2 END AS INTEGER) AS evidence, count(*) AS n FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 GROUP BY 1, 2, 3")
def role_evidence(spark, d):
    rows = C.blocks(messages(spark, d))
    return rows.groupBy("role", E.speaker(F.col("role"), F.col("block_type"), F.col("injected")).alias("label"), E.evidence_for(F.col("role"), F.col("block_type"), F.col("injected")).alias("evidence")).agg(F.count("*").alias("n"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role FROM conversations WHERE turn % 5 <> 4")
def events_to_messages(spark, d):
    kinds = F.when(F.col("turn") % 5 == 4, "system/message").when(F.col("turn") % 3 == 0, "user/message").when(F.col("turn") % 3 == 1, "assistant/message").otherwise("tool/result")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    events = _read(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("bigint").alias("seq"), kinds.alias("event_type"),
        F.struct(F.lit(None).cast("string").alias("role"), block.alias("content"), F.struct(F.lit(None).cast("string").alias("kind")).alias("source")).alias("data"),
    )
    return L.events_to_messages(events).select("session_id", "seq", "role")


def _credential_literals() -> list[str]:
    """One text of each kind, put together here so that no credential-shaped text stands in the repository."""
    a, h = "Ab3dEf6hJk" * 5, "0123456789abcdef" * 3
    return [
        "sk" + "-" + a[:24], "sk" + "-ant-" + a[:24], "AI" + "za" + a[:34], "gh" + "p_" + a[:34], "github" + "_pat_" + a[:34], "h" + "f_" + a[:34], "AK" + "IA" + "ABCDEFGH12345678",
        "xo" + "xb-" + a[:14], "sk" + "_live_" + a[:24], "np" + "m_" + a[:34], "ey" + "J" + a[:14] + ".ey" + "J" + a[:14] + "." + a[:14], h[:32] + "." + a[:16],
        "-----BEGIN RSA " + "PRIVATE KEY-----\nabc\n-----END RSA " + "PRIVATE KEY-----", "api_key" + " = \"" + a[:20] + "\"", "密码: " + a[:18], "nothing here",
    ]


def _redact_sql(x: str) -> str:
    for kind, pattern in T.CREDENTIALS:
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED:{kind}]', 'g')"
    labels = T.CREDENTIAL_LABELS
    return f"regexp_replace({x}, '(?i)((?:{labels})[\"''`]?\\s*[:=＝]\\s*[\"''`]?)([A-Za-z0-9_\\-./+]{{16,}})([\"''`]?)', '\\1[REDACTED:labelled]\\3', 'g')"


def _spiked_sql() -> str:
    cases = " ".join("WHEN %d THEN '%s'" % (i, x.replace("'", "''")) for i, x in enumerate(_credential_literals()))
    return f"(SELECT doc_id, text || ' 密钥' || (CASE doc_id % {len(_credential_literals())} {cases} END) AS t FROM documents)"


@query(f"SELECT doc_id, md5({_redact_sql('t')}) AS redacted_md5, CAST(len(regexp_extract_all({_redact_sql('t')}, '\\[REDACTED:')) AS BIGINT) AS n FROM {_spiked_sql()}")
def redacted_text(spark, d):
    literals = _credential_literals()
    extra = F.element_at(F.array(*map(F.lit, literals)), (F.col("doc_id") % len(literals) + 1).cast("int"))
    rows = _read(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" 密钥"), extra).alias("t"))
    rows = rows.select("doc_id", "t", T.redact(F.col("t")).alias("clean"))
    return rows.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("redacted_md5"), T.redactions(F.col("t"), F.col("clean")).alias("n"))


@query("SELECT doc_id, CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


_FLAT = """l AS (SELECT conv_id, turn, '[' || (CASE role WHEN 'user' THEN 'user' WHEN 'tool' THEN 'tool' ELSE 'assistant' END) || '] ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM conversations WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0),
f AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS t FROM l GROUP BY conv_id)"""


@query(f"WITH {_FLAT} SELECT CAST(conv_id AS VARCHAR) AS session_id, length(t) > 600 AS truncated, CASE WHEN length(t) > 600 THEN '{C.CUT_MARK.strip()}' || chr(10) || right(t, 600) ELSE t END AS text FROM f")
def truncate_tail(spark, d):
    return C.flatten(messages(spark, d), max_chars=600).select("session_id", "truncated", "text")


@query(f"""WITH {_FLAT}, p AS (SELECT conv_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM f),
r AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i) AS used FROM p)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN length(any_value(t)) <= 800 THEN any_value(t) ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (used <= 800), '') END AS text FROM r GROUP BY conv_id""")
def truncate_budget(spark, d):
    return C.truncate_lines(C.flatten(messages(spark, d), max_chars=1 << 30).select("session_id", "text"), 200)


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_max(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), turn) AS text FROM conversations WHERE role = 'user' AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 GROUP BY conv_id")
def latest_user_text(spark, d):
    return C.latest_user_text(messages(spark, d))


@query(f"""WITH {_CLAIMS} SELECT CAST(conv_id % 10 AS BIGINT) AS merge_group, key, value, text FROM cl WHERE length(key) > 0
QUALIFY row_number() OVER (PARTITION BY conv_id % 10, key, value ORDER BY evidence DESC, length(text) DESC, text) = 1""")
def best_claim_text(spark, d):
    grouped = messages(spark, d).withColumn("merge_group", F.col("session_id").cast("long") % 10)
    return O.best_texts(C.claims(grouped), ["merge_group", "key"])


@query("""WITH c AS (SELECT CAST(l_partkey AS VARCHAR) AS key, l_returnflag AS value, l_orderkey * 10 + l_linenumber AS claim_ord, 1 + l_linenumber % 4 AS e FROM lineitem)
SELECT key, value, claim_ord, CAST(row_number() OVER (PARTITION BY key, value ORDER BY e DESC, claim_ord) AS INTEGER) AS quote_rank FROM c QUALIFY quote_rank <= 3""")
def top3_quotes(spark, d):
    return O.top_quotes(line_opinions(spark, d), ["key"]).select("key", "value", "claim_ord", "quote_rank")


@query("""WITH w AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]{4,}', 0)) AS word FROM benchmark),
n AS (SELECT """ + _norm_sql("text").replace("[`*_#>\\[\\]()]", "[_`*]") + """ AS t FROM documents)
SELECT item_id, count(*) FILTER (length(word) > 0 AND contains(t, word)) AS n_documents FROM w CROSS JOIN n GROUP BY item_id""")
def mentions_coverage(spark, d):
    """How many documents mention the first longer word of each benchmark item: all items against all documents."""
    items = _read(spark, d, "benchmark").select("item_id", F.regexp_extract("text", "[A-Za-z]{4,}", 0).alias("value"))
    return C.mention_counts(_read(spark, d, "documents"), items, "item_id")


# --- conflicts and settlements ----------------------------------------------------------

_TIED = f"{_ITEMS}, {_decide_sql()}, tied AS (SELECT top.k, top.v FROM top JOIN dec USING (k) WHERE score = best AND outcome = 'disputed')"


@query(f"""WITH {_TIED}, p AS (SELECT k, v, count(DISTINCT s) AS n FROM tied JOIN items USING (k, v) GROUP BY k, v), c AS (SELECT k, count(*) AS n_options, CAST(sum(n) AS BIGINT) AS n_sources FROM p GROUP BY k)
SELECT k AS key, n_options, n_sources, CAST(row_number() OVER (ORDER BY n_sources DESC, k) AS INTEGER) AS rank FROM c QUALIFY rank <= 12""")
def disputed_top12(spark, d):
    op = line_opinions(spark, d)
    return O.conflicts(op, O.decide(O.items(op, ["key"]), ["key"]), ["key"])


@query(f"""WITH {_TIED}, o AS (SELECT k, min(v) AS lo, max(v) AS hi FROM tied GROUP BY k)
SELECT k AS key, CASE WHEN CAST(k AS BIGINT) % 3 = 0 THEN 'unresolvable' ELSE 'choose' END AS outcome, CASE WHEN CAST(k AS BIGINT) % 3 <> 0 THEN lower(lo) END AS value, CAST(k AS BIGINT) % 3 = 0 AS order_sensitive FROM o WHERE CAST(k AS BIGINT) % 5 <> 0""")
def reconcile_settlements(spark, d):
    decided = O.decide(O.items(line_opinions(spark, d), ["key"]), ["key"]).where("outcome = 'disputed'")
    n = F.col("key").cast("long")
    forward = decided.select("key", F.lit("choose").alias("outcome"), F.lower(F.array_min("tied")).alias("value"), F.lit(None).cast("string").alias("guard"))
    backward = decided.where(n % 5 != 0).select("key", F.lit("choose").alias("outcome"), F.lower(F.when(n % 3 == 0, F.array_max("tied")).otherwise(F.array_min("tied"))).alias("value"))
    return M.reconcile(forward, backward, ["key"]).drop("guard")


def _alignment_answers(spark: SparkSession) -> DataFrame:
    """Answers of a model, good and bad ones, for fixed merge groups."""
    slot = '{"key":" DB.Engine ","type":"Fact","opinions":[{"source":"a","value":"PostgreSQL","evidence":4,"quote":"q1"},{"source":"b","value":" mysql","evidence":"2.5"},{"source":"zz","value":"x","evidence":1},{"source":"b","value":"","evidence":9}]}'
    again = '{"key":"db.engine","type":"Goal","opinions":[{"source":"a","value":"late","evidence":1}]}'
    odd = '{"key":"cache.ttl","type":"Nonsense","derivedFrom":["db.engine","","db.engine"],"opinions":[{"source":"b","value":"sixty","evidence":null}]}, {"key":"","opinions":[]}, {"key":"lonely","opinions":[]}, 7'
    return spark.createDataFrame([(1, "```json\n{\"slots\":[" + slot + "," + again + "," + odd + "]}\n```"), (2, "I think: {\"slots\":[" + slot + "]} done"), (3, "no json"), (4, None)], "merge_group long, answer string")


_OPINIONS = """(1, 'cache.ttl', 'Fact', 'b', 'sixty', 1, 'cache.ttl = sixty', 'db.engine'), (1, 'db.engine', 'Fact', 'a', 'postgresql', 4, 'q1', ''), (1, 'db.engine', 'Fact', 'b', 'mysql', 3, 'db.engine = mysql', ''),
(2, 'db.engine', 'Fact', 'a', 'postgresql', 4, 'q1', ''), (2, 'db.engine', 'Fact', 'b', 'mysql', 3, 'db.engine = mysql', '')"""


@query(f"SELECT CAST(g AS BIGINT) AS merge_group, key, slot_type, source, value, CAST(evidence AS INTEGER) AS evidence, quote, derived_csv FROM (VALUES {_OPINIONS}) AS t(g, key, slot_type, source, value, evidence, quote, derived_csv)")
def parse_alignment(spark, d):
    sources = spark.createDataFrame([(g, s) for g in (1, 2) for s in "ab"], "merge_group long, source string")
    found, _ = M.parse_alignment(_alignment_answers(spark), sources)
    return found.select("merge_group", "key", "slot_type", "source", "value", "evidence", "quote", F.array_join("derived_from", ",").alias("derived_csv"))


@query("SELECT CAST(g AS BIGINT) AS merge_group, reason, CAST(n AS BIGINT) AS n FROM (VALUES (1, 'bad-key', 2), (1, 'empty-value', 1), (1, 'no-opinions', 1), (1, 'not-object', 1), (1, 'unknown-source', 1), (2, 'empty-value', 1), (2, 'unknown-source', 1)) AS t(g, reason, n)")
def alignment_rejects(spark, d):
    sources = spark.createDataFrame([(g, s) for g in (1, 2) for s in "ab"], "merge_group long, source string")
    return M.parse_alignment(_alignment_answers(spark), sources)[1]


# --- premises and trust -------------------------------------------------------------------


def premise_slots(spark, d) -> DataFrame:
    """Part slots in 20 groups; a part rests on the one before it in its group, some also on the one before that."""
    decided = O.decide(O.items(line_opinions(spark, d), ["key"]), ["key"])
    n = F.col("key").cast("long")
    one, two = F.array((n - 20).cast("string")), F.array((n - 40).cast("string"))
    routes = F.when((n % 5 == 0) | (n <= 40), F.array().cast("array<array<string>>")).when(n % 97 == 0, F.array(F.array((n + 1000000).cast("string")))).when(n % 7 == 0, F.array(one, two)).otherwise(F.array(one))
    shown = O.presented(F.col("outcome"), F.col("winner"), F.col("tied"))
    return decided.select((n % 20).alias("merge_group"), "key", (F.col("outcome") == "resolved").alias("asserted"), routes.alias("routes"), shown.alias("values"))


_PREMISES = f"""{_ITEMS}, {_decide_sql()},
sl AS (SELECT CAST(k AS BIGINT) AS n, outcome = 'resolved' AS asserted, outcome FROM dec),
rt AS (SELECT n, 1 AS r, n - 20 AS p FROM sl WHERE n % 5 <> 0 AND n > 40 AND n % 97 <> 0 UNION ALL SELECT n, 2, n - 40 FROM sl WHERE n % 5 <> 0 AND n > 40 AND n % 97 <> 0 AND n % 7 = 0
  UNION ALL SELECT n, 1, n + 1000000 FROM sl WHERE n % 5 <> 0 AND n > 40 AND n % 97 = 0),
inn AS (SELECT n FROM sl WHERE asserted AND n NOT IN (SELECT n FROM rt) UNION SELECT rt.n FROM rt JOIN inn ON rt.p = inn.n JOIN sl ON sl.n = rt.n WHERE sl.asserted)"""


@query(f"""WITH RECURSIVE {_PREMISES} SELECT n % 20 AS merge_group, CAST(sl.n AS VARCHAR) AS key,
CASE WHEN sl.n NOT IN (SELECT n FROM rt) THEN CASE WHEN asserted THEN 'axiom' ELSE 'unasserted' END WHEN EXISTS (SELECT 1 FROM rt JOIN inn ON rt.p = inn.n WHERE rt.n = sl.n) THEN 'founded' ELSE 'retracted' END AS status,
CASE WHEN sl.n IN (SELECT n FROM rt) AND NOT EXISTS (SELECT 1 FROM rt JOIN inn ON rt.p = inn.n WHERE rt.n = sl.n) THEN (SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR)) FROM rt WHERE rt.n = sl.n) ELSE '' END AS unmet_csv FROM sl""")
def derivation_status(spark, d):
    return D.derive(premise_slots(spark, d), ["merge_group"]).select("merge_group", "key", "status", F.array_join("unmet", ",").alias("unmet_csv"))


@query(f"""WITH RECURSIVE {_PREMISES}, st AS (SELECT n % 20 AS merge_group, CASE WHEN n NOT IN (SELECT n FROM rt) THEN CASE WHEN asserted THEN 'in' ELSE 'un' END WHEN EXISTS (SELECT 1 FROM rt JOIN inn ON rt.p = inn.n WHERE rt.n = sl.n) THEN 'in' ELSE 'retracted' END AS s, n IN (SELECT n FROM rt) AS derived FROM sl)
SELECT merge_group, count(*) FILTER (s = 'in') AS in_count, count(*) FILTER (s = 'retracted') AS retracted_count, count(*) FILTER (derived) AS derived_count FROM st GROUP BY merge_group""")
def derivation_counters(spark, d):
    return D.counters(D.derive(premise_slots(spark, d), ["merge_group"]), ["merge_group"])


@query(f"WITH RECURSIVE {_PREMISES} SELECT DISTINCT rt.n % 20 AS merge_group, CAST(p AS VARCHAR) AS premise FROM rt WHERE p NOT IN (SELECT n FROM sl)")
def unknown_premises(spark, d):
    return D.unknown_premises(premise_slots(spark, d), ["merge_group"])


_TRUST = """sup AS (SELECT CAST(l_partkey AS BIGINT) AS n, l_returnflag AS v, l_suppkey % 3 AS trust FROM lineitem), shown AS (SELECT CAST(top.k AS BIGINT) AS n, top.v FROM top WHERE score = best),
tr AS (SELECT n, max(trust) AS trust FROM sup JOIN shown USING (n, v) GROUP BY n)"""


@query(f"WITH {_ITEMS}, {_decide_sql()}, {_TRUST} SELECT n % 20 AS merge_group, CAST(n AS VARCHAR) AS key, CAST(trust AS INTEGER) AS trust FROM tr")
def slot_trust(spark, d):
    c = line_opinions(spark, d).withColumn("merge_group", F.col("key").cast("long") % 20)
    return D.slot_trust(c, premise_slots(spark, d), ["merge_group", "key"])


@query(f"WITH RECURSIVE {_PREMISES}, {_TRUST}, lo AS (SELECT rt.n, r, min(coalesce(trust, 0)) AS low FROM rt LEFT JOIN tr ON tr.n = rt.p GROUP BY rt.n, r) SELECT n % 20 AS merge_group, CAST(n AS VARCHAR) AS key, CAST(max(low) AS INTEGER) AS ceiling FROM lo GROUP BY n")
def derivation_ceiling(spark, d):
    c = line_opinions(spark, d).withColumn("merge_group", F.col("key").cast("long") % 20)
    slots = premise_slots(spark, d)
    return D.trust_ceiling(slots, D.slot_trust(c, slots, ["merge_group", "key"]), ["merge_group"])


@query(f"""WITH RECURSIVE {_PREMISES}, {_TRUST}, lo AS (SELECT rt.n, r, min(coalesce(trust, 0)) AS low FROM rt LEFT JOIN tr ON tr.n = rt.p GROUP BY rt.n, r), ce AS (SELECT n, max(low) AS ceiling FROM lo GROUP BY n),
bare AS (SELECT DISTINCT n FROM sup JOIN shown USING (n, v) WHERE trust = 0 AND n % 11 = 0)
SELECT n % 20 AS merge_group, CAST(n AS VARCHAR) AS key, 'derivation-ceiling' AS rule FROM ce JOIN tr USING (n) WHERE trust > ceiling UNION ALL SELECT n % 20, CAST(n AS VARCHAR), 'unlabelled' FROM bare""")
def trust_violations(spark, d):
    n = F.col("key").cast("long")
    c = line_opinions(spark, d).withColumn("merge_group", n % 20).withColumn("trust", F.when(~((F.col("trust") == 0) & (n % 11 == 0)), F.col("trust")))
    return D.trust_violations(c, premise_slots(spark, d), ["merge_group"])


# --- utility, layout, packing, rendering ------------------------------------------------------


def featured(spark, d) -> DataFrame:
    op = line_opinions(spark, d)
    state = O.items(op, ["key"])
    slots = P.features(state, op, O.decide(state, ["key"]), ["key"])
    kinds = F.array(*map(F.lit, E.SLOT_TYPES))
    n = F.col("key").cast("long")
    return slots.withColumn("slot_type", F.element_at(kinds, (n % 7 + 1).cast("int"))).withColumn("merge_group", n % 20)


_KINDS = "CASE CAST(k AS BIGINT) % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(E.SLOT_TYPES)) + " END"


def _case(table: dict[str, float]) -> str:
    return f"CASE {_KINDS} " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in table.items()) + " ELSE 1 END"


_FEATURES = f"""{_ITEMS}, {_decide_sql()}, ft AS (SELECT k, max(e) AS ev, count(DISTINCT s) AS ns FROM items GROUP BY k),
su AS (SELECT CAST(l_partkey AS VARCHAR) AS k, max(l_suppkey % 3) AS trust FROM lineitem JOIN (SELECT k, v FROM top WHERE score = best) t ON t.k = CAST(l_partkey AS VARCHAR) AND t.v = l_returnflag GROUP BY 1),
fe AS (SELECT k, CAST(k AS BIGINT) % 20 AS g, outcome, ev, ns, trust, CAST({_case(P.TYPE_VALUE)} + 3 * ev + 2 * ns + 4 * trust AS DOUBLE) AS worth,
  CAST({_case(P.TYPE_STABILITY)} + CASE WHEN outcome = 'resolved' THEN 3 ELSE 0 END + 0.5 * ev + 0.5 * ns + 0.25 * trust AS DOUBLE) AS stable FROM dec JOIN ft USING (k) JOIN su USING (k))"""


@query(f"WITH {_FEATURES} SELECT k AS key, round(CASE WHEN CAST(k AS BIGINT) % 9 = 0 THEN worth * 0.05 ELSE worth END, 6) AS utility FROM fe")
def utility_personal(spark, d):
    return featured(spark, d).select("key", F.round(P.personal_utility(retracted=F.col("key").cast("long") % 9 == 0), 6).alias("utility"))


@query(f"WITH {_FEATURES} SELECT g AS merge_group, k AS key, stable AS stability, CAST(row_number() OVER (PARTITION BY g ORDER BY stable DESC, k) AS INTEGER) AS position FROM fe")
def stability_layout(spark, d):
    return P.ordered(featured(spark, d).withColumn("stability", P.stability()), ["merge_group"], F.col("stability")).select("merge_group", "key", "stability", "position")


@query(f"WITH {_FEATURES} SELECT g AS merge_group, k AS key, CAST(row_number() OVER (PARTITION BY g ORDER BY ev * 100 + ns * 10 DESC, k) AS INTEGER) AS position FROM fe")
def legacy_order(spark, d):
    return P.ordered(featured(spark, d), ["merge_group"], P.priority()).select("merge_group", "key", "position")


@query(f"""WITH {_FEATURES}, a AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY stable DESC, k) AS i FROM fe), b AS (SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN CAST(k AS BIGINT) % 53 = 0 THEN 0 ELSE stable END DESC, k) AS i FROM fe)
SELECT a.g AS merge_group, CAST(coalesce(min(a.i) FILTER (a.k <> b.k) - 1, max(a.i)) AS BIGINT) AS prefix FROM a JOIN b ON a.g = b.g AND a.i = b.i GROUP BY a.g""")
def prefix_preserved(spark, d):
    f = featured(spark, d).withColumn("s", P.stability())
    churned = F.when(F.col("key").cast("long") % 53 == 0, 0.0).otherwise(F.col("s"))
    return P.common_prefix(P.ordered(f, ["merge_group"], F.col("s")), P.ordered(f, ["merge_group"], churned), ["merge_group"])


_REL = ["the", "thing", "onre", "zebra"]


@query("SELECT doc_id, round((" + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in _REL) + f") / {float(len(_REL))}, 6) AS relevance FROM documents")
def relevance(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.round(T.relevance(F.col("text"), " ".join([*_REL, "the", "of"])), 6).alias("relevance"))


def _packable(spark, d) -> DataFrame:
    n = F.col("key").cast("long")
    return featured(spark, d).withColumn("cost", (10 + n % 37).cast("long")).withColumn("worth", P.personal_utility())


@query()
def pack_density(spark, d):
    return P.pack_groups(_packable(spark, d), ["merge_group"], 150, "density")


@query()
def pack_partial(spark, d):
    return P.pack_groups(_packable(spark, d), ["merge_group"], 150, "partial")


def _merged_lines(spark, d) -> G.Merged:
    """Line opinions in 20 groups as a finished merge; the claims of some parts have no trust, which no group may show."""
    n = F.col("key").cast("long")
    claims = line_opinions(spark, d).withColumn("merge_group", n % 20).withColumn("trust", F.when(n % 388 != 0, F.col("trust"))).withColumn("text", F.concat(F.lit("flag "), "value")).withColumn("slot_type", F.lit("Fact"))
    state, slots = G.decided_slots(claims)
    groups = slots.select("merge_group").distinct()
    ties = slots.groupBy("merge_group").agg(F.count_if(F.col("outcome") == "disputed").alias("conflicts"), F.count_if(F.col("outcome") == "resolved").alias("in_count"))
    return G.Merged(claims, state, slots, groups.withColumn("redacted", F.col("merge_group") % 3), G._reported(groups, ties))


@query(f"""WITH {_ITEMS}, {_decide_sql()}, per AS (SELECT CAST(k AS BIGINT) % 20 AS merge_group, count(*) AS n_slots, count(*) FILTER (CAST(k AS BIGINT) % 388 = 0) AS violations, count(*) FILTER (outcome = 'disputed') AS conflicts, count(*) FILTER (outcome = 'resolved') AS in_count FROM dec GROUP BY 1)
SELECT merge_group, n_slots, violations, violations > 0 AS refused, violations = 0 AS injected, merge_group % 3 AS redacted, 'heuristic' AS mode, 'none' AS adjudication, conflicts, in_count, CASE WHEN violations > 0 THEN 'trust' END AS reason FROM per""")
def apply_step(spark, d):
    out = G.guarded(_merged_lines(spark, d), budget=400, algorithm="density")
    return out.select("merge_group", "n_slots", "violations", "refused", "injected", "redacted", "mode", "adjudication", "conflicts", "in_count", "reason")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS seq, CASE role WHEN 'user' THEN 'user' WHEN 'tool' THEN 'tool' ELSE 'assistant' END AS role, text FROM conversations")
def to_messages(spark, d):
    """A row for each session with its events as an array, read as messages."""
    c = _read(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "user/message").when(F.col("role") == "tool", "tool/result").otherwise("assistant/message")
    data = F.struct(F.col("role").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), F.struct(F.lit(None).cast("string").alias("kind")).alias("source"))
    packed = c.groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("turn"), kind.alias("event_type"), data.alias("data")))).alias("events"))
    back = L.to_messages(packed).join(packed.select("session_id", F.transform("events", lambda e: e["turn"]).alias("turns")), "session_id")
    return back.select("session_id", F.get("turns", F.col("seq").cast("int")).cast("bigint").alias("seq"), "role", F.col("blocks")[0]["text"].alias("text"))


@query()
def render_block(spark, d):
    grouped = messages(spark, d).withColumn("merge_group", F.col("session_id").cast("long") % 25)
    return G.merge_sessions(grouped, budget=400, algorithm="density")


@query(f"WITH {_ITEMS}, {_decide_sql()} SELECT CAST(k AS BIGINT) % 20 AS merge_group, k AS key, outcome, CASE WHEN outcome = 'resolved' THEN winner ELSE tied_csv END AS values_csv FROM dec")
def parse_context(spark, d):
    op = line_opinions(spark, d).withColumn("merge_group", F.col("key").cast("long") % 20).withColumn("text", F.concat(F.lit("flag "), "value"))
    keys = ["merge_group", "key"]
    state = O.items(op, keys)
    lines = R.slot_lines(O.decide(state, keys), state, op, keys)
    rows = lines.select("merge_group", F.col("key").cast("long").alias("k"), F.posexplode(F.split("body", "\n")).alias("i", "line")).select("merge_group", (F.col("k") * 100 + F.col("i")).alias("line_no"), "line")
    return R.parse_lines(rows, ["merge_group"]).select("merge_group", "key", "outcome", F.array_join("values", ",").alias("values_csv"))


# --- sessions ------------------------------------------------------------------------------


def candidates(spark, d) -> DataFrame:
    """Conversations as candidate sessions; every seventh has no modification time."""
    c = _read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("bytes"), F.count("*").alias("n"))
    return c.select(
        F.concat(F.lit("s"), (F.col("conv_id") * 37 % 1009).cast("string"), F.lit("-"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("Talk "), F.col("n").cast("string")).alias("title"),
        F.when(F.col("conv_id") % 7 > 0, (F.col("n") * 1000).cast("long")).alias("mtime"), "bytes", F.lit(None).cast("string").alias("workspace"), F.col("conv_id").alias("input_ord"),
    )


_CAND = "ca AS (SELECT 's' || (conv_id * 37 % 1009) || '-' || conv_id AS id, 'Talk ' || count(*) AS title, CASE WHEN conv_id % 7 > 0 THEN count(*) * 1000 END AS mtime, CAST(sum(length(text)) AS BIGINT) AS bytes, conv_id AS input_ord FROM conversations GROUP BY conv_id)"


@query(f"WITH {_CAND} SELECT id, CAST(row_number() OVER (ORDER BY coalesce(mtime, 0) DESC, input_ord) AS INTEGER) AS position FROM ca WHERE id <> 's37-1' AND contains(lower(title || ' ' || id || ' '), 's3') QUALIFY position <= 20")
def rank_sessions(spark, d):
    return S.rank(candidates(spark, d), query="S3", exclude=["s37-1"]).select("id", "position")


_TOKENS = ["s37-1", "2", "9999", "s74", "s3", "zz", " s111-3 ", "0"]


@query(f"""WITH {_CAND}, po AS (SELECT id, row_number() OVER (ORDER BY coalesce(mtime, 0) DESC, input_ord) AS position FROM ca), tk AS (SELECT row_number() OVER () - 1 AS token_ord, trim(t) AS token FROM (SELECT unnest({_TOKENS!r}) AS t)),
m AS (SELECT token_ord, token, (SELECT id FROM po WHERE id = token) AS exact, regexp_matches(token, '^[0-9]+$') AS num, (SELECT id FROM po WHERE CAST(position AS VARCHAR) = token) AS nth, (SELECT count(*) FROM po WHERE starts_with(id, token)) AS hits, (SELECT min(id) FROM po WHERE starts_with(id, token)) AS one, (SELECT count(*) FROM po) AS n FROM tk)
SELECT CAST(token_ord AS BIGINT) AS token_ord, token, CASE WHEN exact IS NOT NULL THEN exact WHEN num THEN nth WHEN hits = 1 THEN one END AS id,
CASE WHEN exact IS NOT NULL THEN NULL WHEN num THEN CASE WHEN nth IS NULL THEN 'there is no number ' || token || ' among ' || n || ' sessions' END WHEN hits = 0 THEN 'no id begins with ' || token WHEN hits > 1 THEN token || ' begins ' || hits || ' ids' END AS error FROM m""")
def resolve_sessions(spark, d):
    tokens = spark.createDataFrame(list(enumerate(_TOKENS)), "token_ord long, token string")
    return S.resolve(tokens, S.rank(candidates(spark, d), limit=None))


@query(f"""WITH {_CAND}, po AS (SELECT *, row_number() OVER (ORDER BY coalesce(mtime, 0) DESC, input_ord) AS position FROM ca QUALIFY position <= 20), s AS (SELECT *, greatest(0, floor((9000000 - mtime) / 1000 + 0.5)) AS secs FROM po)
SELECT CAST(position AS INTEGER) AS position, ' ' || lpad(CAST(position AS VARCHAR), 3, ' ') || '  ' || rpad(id, 39, ' ') || ' ' || lpad(CASE WHEN mtime IS NULL THEN '?' WHEN secs < 3600 THEN CAST(floor(secs / 60 + 0.5) AS BIGINT) || 'm' ELSE CAST(floor(secs / 3600 + 0.5) AS BIGINT) || 'h' END, 3, ' ') || ' ' ||
lpad(CASE WHEN bytes < 1024 THEN bytes || 'B' WHEN bytes < 1048576 THEN CAST(floor(bytes / 1024 + 0.5) AS BIGINT) || 'K' ELSE 'M' END, 5, ' ') || '  ' || left(title, 46) AS line FROM s""")
def list_sessions(spark, d):
    return S.listing(S.rank(candidates(spark, d)), now_ms=9_000_000)


# --- streams and pipelines ----------------------------------------------------------------------


def _event_opinions(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.to_date("ts").cast("string").alias("source"), (1 + F.col("event_id") % 4).cast("int").alias("evidence"), F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, event_type AS value, CAST(CAST(ts AS DATE) AS VARCHAR) AS source, CAST(1 + event_id % 4 AS INTEGER) AS evidence FROM events")
def stream_distinct_claims(spark, d):
    op = _event_opinions(ST.read_table(spark, d, "events")).drop("ts")
    return ST.run_to_end(ST.distinct_claims(op, ["key"]), "concordia_distinct_claims", "append")


@query(f"""WITH items AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k, event_type AS v, CAST(CAST(ts AS DATE) AS VARCHAR) AS s, 1 + event_id % 4 AS e FROM events), {_decide_sql()} SELECT k AS key, {_DEC_COLS} FROM dec""")
def stream_slot_decisions(spark, d):
    op = _event_opinions(ST.read_table(spark, d, "events")).drop("ts")
    return _flat(ST.run_to_end(ST.slot_decisions(op, ["key"]), "concordia_slot_decisions", "complete"), "key")


@query(f"""WITH items AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS k, event_type AS v, CAST(CAST(ts AS DATE) AS VARCHAR) AS s, 1 + event_id % 4 AS e FROM events), {_decide_sql()} SELECT k AS key, CASE outcome WHEN 'resolved' THEN 'resolved:' || winner ELSE 'disputed:' || tied_csv END AS decision, n_items FROM dec""")
def stream_stateful_decisions(spark, d):
    op = _event_opinions(ST.read_table(spark, d, "events")).drop("ts")
    return ST.run_to_end(ST.stateful_decisions(op, ["key"]), "concordia_stateful", "update")


# The published means over seeds 1-5 at 400 and 1200 tokens (2 branches, 10 topics, 50 bridge questions).
_PUBLISHED = """(400, 'none', 0, 0, 0, 0, 0.0, 0), (400, 'single', 0.5, 0, 0, 0.5, 0.0, 0), (400, 'concat', 0.6, 0.18, 0.18, 0.5, 0.0, 0), (400, 'heuristic', 0.95, 0.98, 0.98, 0.5, 0.8, 0), (400, 'oracle', 1, 1, 1, 1, 0.0, 0),
(1200, 'single', 0.5, 0, 0, 0.5, 0.0, 0), (1200, 'concat', 1, 1, 1, 0, 2.0, 0), (1200, 'heuristic', 1, 1, 1, 0, 2.0, 0), (1200, 'oracle', 1, 1, 1, 1, 0.0, 0)"""
_MEANS = ["local", "bridge", "bridge_gain", "unambiguous", "both_values", "invented"]


@query("SELECT CAST(budget AS INTEGER) AS budget, arm, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MEANS) + f" FROM (VALUES {_PUBLISHED}) AS t(budget, arm, {', '.join(_MEANS)})")
def bench_rollup(spark, d):
    parts = [B.rollup(B.score(spark, seeds=range(1, 6), budget=b)).select(F.lit(b).alias("budget"), "arm", *_MEANS) for b in (400, 1200)]
    return parts[0].unionByName(parts[1].where("arm <> 'none'"))


@query("SELECT CAST(seed AS BIGINT) AS seed, CAST(2 AS BIGINT) AS total, CAST(2 AS BIGINT) AS correct, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS missing, CAST(1 AS DOUBLE) AS accuracy FROM range(1, 6) t(seed)")
def bench_conflicts_oracle(spark, d):
    facts, _, _ = B.tables(spark, range(1, 6), topics=10)
    claims = B.oracle_claims(facts)
    state, slots = G.decided_slots(claims)
    text = G.render_claims(claims, slots, state, budget=1200).select(F.col("merge_group").alias("seed"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return B.conflict_decisions(facts, R.parse_lines(text, ["seed"]))


@query()
def bench_tokens(spark, d):
    return B.rollup(B.score(spark, seeds=range(1, 6), budget=400)).select("arm", "tokens")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to decided slots: redact, split, key, merge, decide."""
    return heuristic_merge(spark, sf_dir)
