"""A synthetic benchmark of merging: seeded scenarios, ways of building context, and their scores.

A scenario spreads facts over branches so that some questions need two of
them.  Its tables are made on the driver (a few hundred rows a seed, as the
generator is one sequence of draws); building contexts and scoring are plans
over all seeds at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as C
from ..sources.logs import BLOCKS
from . import merge as G

# Topics (key, right value, other value, sentence) and small talk.
TOPICS = (
    ("database.engine", "postgresql", "mysql", "The database engine is {}."),
    ("cache.ttl_seconds", "sixty", "three_hundred", "The cache TTL is {} seconds."),
    ("pool.max_connections", "twenty", "fifty", "The connection pool cap is {}."),
    ("retry.max_attempts", "three", "five", "Retries are capped at {}."),
    ("auth.provider", "oauth", "saml", "Authentication uses {}."),
    ("deploy.target", "kubernetes", "lambda", "We deploy to {}."),
    ("queue.broker", "kafka", "rabbitmq", "The queue broker is {}."),
    ("storage.format", "jsonl", "parquet", "Records are stored as {}."),
    ("cache.backend", "redis", "memcached", "The cache backend is {}."),
    ("logging.sink", "stdout", "file", "Logs go to {}."),
    ("search.index", "elasticsearch", "sqlite_fts", "Search is backed by {}."),
    ("region.primary", "us_east", "eu_west", "The primary region is {}."),
    ("metrics.exporter", "prometheus", "statsd", "Metrics go to {}."),
    ("ci.runner", "github_actions", "jenkins", "CI runs on {}."),
    ("secrets.store", "vault", "aws_secrets_manager", "Secrets live in {}."),
    ("cdn.provider", "cloudflare", "fastly", "The CDN is {}."),
)
CHATTER = (
    "Sure, let me look into that and get back to you with what I find.",
    "That sounds reasonable to me, though I would want to check the details first.",
    "I will check the configuration next and report anything that looks off.",
    "Thanks, that clarifies things quite a bit for the direction we are taking.",
    "Let me know if you want me to dig deeper into any particular part of this.",
    "Okay, moving on to the next item on the list we agreed earlier today.",
    "I think there are a couple of trade-offs worth writing down before we commit.",
    "That matches what I remembered from the earlier discussion on this topic.",
    "Before we change anything I would like to see how it behaves under load.",
    "Good point, I had not considered that angle when we first looked at it.",
    "Let me summarise where we are so far so nothing gets lost in the thread.",
    "I would rather keep the current setup until we have a concrete reason to move.",
)
USER_STATED, INFERRED = 4, 2
_MASK = 0xFFFFFFFF


def draw(seed: int, n: int) -> float:
    """The n-th number (from 1) of the seed's sequence in [0, 1): a mix of seed + n * step, so any draw stands alone."""
    a = (seed + n * 0x6D2B79F5) & _MASK
    t = ((a ^ (a >> 15)) * (a | 1)) & _MASK
    t ^= (t + ((t ^ (t >> 7)) * (t | 61) & _MASK)) & _MASK
    return ((t ^ (t >> 14)) & _MASK) / 4294967296


@dataclass
class Draws:
    seed: int
    n: int = 0

    def next(self) -> float:
        self.n += 1
        return draw(self.seed, self.n)

    def shuffled(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = int(self.next() * (i + 1))
            out[i], out[j] = out[j], out[i]
        return out


@dataclass
class Scenario:
    seed: int
    facts: list[tuple] = field(default_factory=list)  # ord, key, value, branch, evidence, correct
    messages: list[tuple] = field(default_factory=list)  # branch, seq, role, source_kind, type, text
    topics: list[str] = field(default_factory=list)


def scenario(seed: int, branches: int = 2, topics: int = 8, conflicts: int = 2, chatter: int = 18) -> Scenario:
    if branches < 2:
        raise ValueError("a merge needs two branches or more")
    rng = Draws(seed)
    chosen = rng.shuffled(list(TOPICS))[:topics]
    names = [f"branch-{chr(97 + i)}" for i in range(branches)]
    owner = {t[0]: names[i % branches] for i, t in enumerate(chosen)}
    facts = [(t[0], t[1], owner[t[0]], USER_STATED, True) for t in chosen]
    facts += [(t[0], t[2], next(b for b in names if b != owner[t[0]]), INFERRED, False) for t in rng.shuffled(chosen)[:conflicts]]
    said = _utterances(facts, seed, rng.n, names, chatter)
    place = itertools.count
    messages = [(b, i, *row) for b, rows in itertools.groupby(said, key=lambda u: u.branch) for i, row in zip(place(), (u[4:] for u in rows), strict=False)]
    return Scenario(seed, [(i, *f) for i, f in enumerate(facts)], messages, [t[0] for t in chosen])


class Utterance(NamedTuple):
    """Sorted by its first four: a branch says its facts, then again what it only concluded, then chatters."""

    branch: str
    part: int
    no: int
    again: int
    role: str
    source_kind: str
    form: str
    text: str


#: How a fact is voiced, by whether the user stated it: part, role, source, block type, wording.
VOICES = {
    True: [(0, "user", "user", "text", "{}")],
    False: [(0, "assistant", "user", "text", "{}"), (0, "assistant", "model", "reasoning", "{} I think."), (1, "assistant", "model", "text", "{}")],
}


def _utterances(facts: list[tuple], seed: int, drawn: int, names: list[str], chatter: int) -> list[Utterance]:
    """All that is said, in order; chatter takes the draws after ``drawn``, branch by branch."""
    wording = {t[0]: t[3] for t in TOPICS}
    about = [
        Utterance(branch, part, no, k, role, kind, form, frame.format(wording[key].format(value)))
        for no, (key, value, branch, level, _) in enumerate(facts) for k, (part, role, kind, form, frame) in enumerate(VOICES[level == USER_STATED])
    ]
    idle = [
        Utterance(branch, 2, i, 0, ("user", "assistant")[i % 2], ("user", "model")[i % 2], "text", CHATTER[int(draw(seed, drawn + b * chatter + i + 1) * len(CHATTER))])
        for b, branch in enumerate(names) for i in range(chatter)
    ]
    return sorted(about + idle)


def tables(spark: SparkSession, seeds: Iterable[int], **shape) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, messages, topics) of all seeds."""
    made = [scenario(s, **shape) for s in seeds]
    facts = spark.createDataFrame([(s.seed, *f) for s in made for f in s.facts], "seed long, ord int, key string, value string, branch string, evidence int, correct boolean")
    rows = [(s.seed, f"{s.seed}/{b}", n, role, kind, [(form, said)]) for s in made for b, n, role, kind, form, said in s.messages]
    messages = spark.createDataFrame(rows, f"merge_group long, session_id string, seq long, role string, source_kind string, blocks {BLOCKS}")
    topics = spark.createDataFrame([(s.seed, i, k) for s in made for i, k in enumerate(s.topics)], "seed long, ord int, key string")
    return facts, messages, topics


def questions(facts: DataFrame, topics: DataFrame) -> DataFrame:
    """(seed, id, kind, values): local ones pair a branch's facts two by two, bridge ones a fact with the first of another branch."""
    right = facts.where("correct")
    w = Window.partitionBy("seed", "branch").orderBy("ord")
    place = right.withColumn("_i", F.row_number().over(w) - 1)
    pairs = place.groupBy("seed", "branch", F.floor(F.col("_i") / 2).alias("p")).agg(F.sort_array(F.collect_list(F.struct("ord", "key", "value"))).alias("f")).where("size(f) = 2")
    local = pairs.select("seed", F.concat(F.lit("local-"), "branch", F.lit("-"), F.col("f")[0]["key"]).alias("id"), F.lit("local").alias("kind"), F.transform("f", lambda x: x["value"]).alias("values"))
    firsts = right.groupBy("seed", "branch").agg(F.min_by(F.struct("ord", "key", "value"), "ord").alias("f")).select(F.col("seed").alias("_seed"), F.col("branch").alias("_branch"), "f")
    own = right.join(topics.select("seed", "key"), ["seed", "key"])
    other = own.join(firsts, (F.col("seed") == F.col("_seed")) & (F.col("branch") != F.col("_branch")))
    bridge = other.groupBy("seed", "key", "value").agg(F.min_by("f", "f.ord").alias("f"))
    return local.unionByName(bridge.select("seed", F.concat(F.lit("bridge-"), "key").alias("id"), F.lit("bridge").alias("kind"), F.array("value", "f.value").alias("values")))


def branch_texts(messages: DataFrame) -> DataFrame:
    """(seed, session_id, text): a branch as its reader sees it."""
    line = F.explode(F.transform("blocks", lambda b: b["text"]))
    rows = messages.select("merge_group", "session_id", "seq", line.alias("line"))
    per = rows.groupBy("merge_group", "session_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))
    return per.select(F.col("merge_group").alias("seed"), "session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def oracle_claims(facts: DataFrame) -> DataFrame:
    """Claims as a perfect reader would align them: the facts themselves."""
    return facts.select(
        F.col("seed").alias("merge_group"), "key", T.normalise_mention(F.col("value")).alias("value"), "evidence", F.col("value").alias("text"), F.concat(F.col("seed").cast("string"), F.lit("/"), "branch").alias("source"),
        F.lit("Fact").alias("slot_type"), F.lit(1).alias("trust"), F.struct("ord").alias("claim_ord"),
    )


def arms(facts: DataFrame, messages: DataFrame, budget: int) -> DataFrame:
    """(seed, arm, text): nothing, the first branch, all branches one after the other, merged by sentence, merged from the facts."""
    texts = branch_texts(messages)
    seeds = facts.select("seed").distinct()
    none = seeds.select("seed", F.lit("none").alias("arm"), F.lit("").alias("text"))
    first = texts.where(F.col("session_id").endswith("/branch-a"))
    single = C.truncate_lines(first.select("seed", "text"), budget, "seed").select("seed", F.lit("single").alias("arm"), "text")
    part = F.concat(F.lit("### "), F.substring_index("session_id", "/", -1), F.lit("\n"), F.col("text"))
    joined = texts.groupBy("seed").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("session_id", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))
    concat = C.truncate_lines(joined, budget, "seed").select("seed", F.lit("concat").alias("arm"), "text")
    trust = messages.select(F.col("session_id").alias("source")).distinct().withColumn("trust", F.lit(1))
    merged = G.merge_sessions(messages, trust, budget=budget).select(F.col("merge_group").alias("seed"), F.lit("heuristic").alias("arm"), "text")
    claims = oracle_claims(facts)
    state, slots = G.decided_slots(claims)
    oracle = G.render_claims(claims, slots, state, budget=budget).select(F.col("merge_group").alias("seed"), F.lit("oracle").alias("arm"), "text")
    return none.unionByName(single).unionByName(concat).unionByName(merged).unionByName(oracle)


def covered(texts: DataFrame, asked: DataFrame, by: str) -> DataFrame:
    """(seed, by, local, bridge, overall, questions): the share of a seed's questions all of whose values its texts mention."""
    hay = texts.withColumn("_hay", T.normalise_mention(F.col("text")))
    met = hay.join(F.broadcast(asked), "seed")
    hit = F.forall("values", lambda v: (F.length(T.normalise_mention(v)) > 0) & F.contains(F.col("_hay"), T.normalise_mention(v))).cast("double")
    rates = [F.coalesce(F.avg(F.when(F.col("kind") == k, hit)), F.lit(0.0)).alias(k) for k in ("local", "bridge")]
    return met.groupBy("seed", by).agg(*rates, F.avg(hit).alias("overall"), F.count("*").alias("questions"))


def branch_coverage(spark: SparkSession, seeds: Iterable[int], **shape) -> DataFrame:
    """(seed, session_id, local, bridge, overall, questions, best, mean): what each branch covers alone, the best and the mean over branches."""
    facts, messages, chosen = tables(spark, seeds, **shape)
    per = covered(branch_texts(messages), questions(facts, chosen), "session_id")
    w = Window.partitionBy("seed")
    return per.withColumns({"best": F.max("overall").over(w), "mean": F.avg("overall").over(w)})


def score(spark: SparkSession, seeds: Iterable[int], budget: int, branches: int = 2, topics: int = 10, conflicts: int = 2, chatter: int = 18) -> DataFrame:
    """One row for each seed and arm: coverage, gain over the best branch, conflicts, invented values, tokens."""
    facts, messages, chosen = tables(spark, seeds, branches=branches, topics=topics, conflicts=conflicts, chatter=chatter)
    from .store import cut

    asked = questions(facts, chosen)
    built = cut(arms(facts, messages, budget))
    single = covered(branch_texts(messages), asked, "session_id").groupBy("seed").agg(F.max("bridge").alias("best_single"))
    fought = facts.groupBy("seed", "key").agg(F.max(F.when(F.col("correct"), F.col("value"))).alias("right"), F.max(F.when(~F.col("correct"), F.col("value"))).alias("wrong"), F.count("*").alias("n")).where("n >= 2")
    met = built.join(F.broadcast(fought), "seed").withColumn("_r", T.mentions(F.col("text"), F.col("right"))).withColumn("_w", T.mentions(F.col("text"), F.col("wrong")))
    ties = met.groupBy("seed", "arm").agg(F.avg((F.col("_r") & ~F.col("_w")).cast("double")).alias("unambiguous"), F.count_if(F.col("_r") & F.col("_w")).alias("both_values"), F.count_if(~F.col("_r") & F.col("_w")).alias("wrong_only"), F.count_if(~F.col("_r") & ~F.col("_w")).alias("absent"), F.count("*").alias("conflicts"))
    words = spark.createDataFrame([(v,) for t in TOPICS for v in t[1:3]], "value string").distinct()
    said = facts.select("seed", "value").distinct()
    never = facts.select("seed").distinct().join(F.broadcast(words)).join(said, ["seed", "value"], "left_anti")
    size = len({v for t in TOPICS for v in t[1:3]})
    invented = built.join(F.broadcast(never), "seed").groupBy("seed", "arm").agg((F.count_if(T.mentions(F.col("text"), F.col("value"))) / size).alias("invented"))
    out = covered(built, asked, "arm").join(single, "seed").join(ties, ["seed", "arm"], "left").join(invented, ["seed", "arm"], "left")
    return out.join(built.select("seed", "arm", T.token_estimate(F.col("text")).alias("tokens")), ["seed", "arm"]).withColumn("bridge_gain", F.col("bridge") - F.col("best_single")).withColumn("tokens_per_question", F.col("tokens") / F.col("questions")).withColumn("unambiguous", F.coalesce("unambiguous", F.lit(1.0)))


def conflict_decisions(facts: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per seed: total, correct, wrong, missing, accuracy of the decisions that a rendered text shows for contested keys.

    parsed: (seed, key, outcome, values) from ``render.parse_lines``; a slot
    without values, or none, is missing; nothing contested is accuracy 1.
    """
    fought = facts.groupBy("seed", "key").agg(F.count("*").alias("n"), F.max(F.when(F.col("correct"), F.col("value"))).alias("right")).where("n >= 2")
    met = fought.join(parsed.select("seed", "key", "values"), ["seed", "key"], "left")
    shown = F.coalesce(F.size("values"), F.lit(0)) > 0
    right = F.coalesce(F.exists("values", lambda v: T.normalise_mention(v) == T.normalise_mention(F.col("right"))), F.lit(False))
    per = met.groupBy("seed").agg(F.count("*").alias("total"), F.count_if(right).alias("correct"), F.count_if(shown & ~right).alias("wrong"), F.count_if(~shown).alias("missing"))
    every = facts.select("seed").distinct().join(per, "seed", "left").fillna(0, ["total", "correct", "wrong", "missing"])
    return every.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(1.0))


def rollup(scored: DataFrame) -> DataFrame:
    """Means over seeds, one row for each arm in a fixed order."""
    names = ["local", "bridge", "bridge_gain", "best_single", "unambiguous", "both_values", "invented", "tokens", "conflicts", "tokens_per_question"]
    per = scored.groupBy("arm").agg(*[F.round(F.avg(c), 4).alias(c) for c in names])
    place = F.array_position(F.array(*map(F.lit, ("none", "single", "concat", "heuristic", "oracle"))), F.col("arm"))
    return per.withColumn("place", place.cast("int")).orderBy("place")
