"""Secret scans: candidates by pattern, false positives removed by a random forest, SQL functions only.

A candidate is a word with a run of 16 or more key characters and a digit
among them, a value of 8 or more after a word such as ``password =``, or a
private key block.  A word that holds several values (JSON, a query string) is
one candidate for each.  Only
texts that hold one are split into words.  Each candidate is described by its
length, its changes of character class, how much of it dictionary words cover,
whether it is part of a path, and its neighbouring words.  The forest is
trained on labelled findings (ours by default, ``labelled_findings``; any
table of value, before, after, secret can be passed) and applied as one
expression, so the scan is a map over documents without a shuffle.

Findings never carry the secret itself, but its length and SHA-256.
Defined cases: null and empty texts, and an empty table, have no findings; a
null id is kept; equal rows have the same findings, each; the same value found
twice gives two findings; a text of any length is scanned whole, in time that
grows with it; other columns are not read.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from .store import WHITE, table

_KEY = r"[A-Za-z0-9+/_=.~-]"
#: A run of 16 or more key characters, up to its first digit; tried at a run's beginning only, so a long one costs its length.
LONG = rf"(?<!{_KEY})(?={_KEY}{{16}})[A-Za-z+/_=.~-]*+[0-9]"
NAMED = r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?)[\"']?\s*(?:[:=]|=>|:=)\s*[\"']?[^\s\"']{8,}"
_LABEL = r"(?i)passw|passphrase|pwd|secret|token|api_?-?key|access_?-?key|auth|bearer|private_?-?key|credential"
_INNOCENT = r"(?i)commit|sha\d*|md5|checksum|digest|hash|uuid|guid|isbn|version|build|revision|serial|invoice|order|phone|card|account|file|path|page|issue|ticket|example|sample|placeholder|dummy|test"
#: A private key block is one word; inside it white space stands as these characters.
BLOCK = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_SPACES, _HELD = " \t\n\x0b\f\r", "\ue000\ue001\ue002\ue003\ue004\ue005"
#: Where a word without spaces holds several values: before a name, between quoted values, between long runs.
#: A run of marks is entered at its beginning only and never given back, so a long one costs its length.
_QUOTE, _MARK = "[\"'`]", r"[,;&|?{}()\[\]<>]"
_BETWEEN = "|".join([
    rf"(?:{_QUOTE}|(?<!{_MARK})){_MARK}++(?:{_QUOTE}?(?=[A-Za-z_][A-Za-z0-9_.-]{{0,60}}{_QUOTE}?[:=]))",
    rf"{_QUOTE}(?=[&?{{}}()\[\]<>]*+[,;|]){_MARK}++{_QUOTE}",
    rf"(?<={_KEY}{{16}}){_QUOTE}?{_MARK}++{_QUOTE}?(?={_KEY}{{16}})",
    rf"(?<={_KEY}{{16}})(?<=[0-9]{_KEY}{{0,15}}):(?={_KEY}{{16}})",
])
#: Words that make a value readable text rather than a key (fixed values).
DICTIONARY = (
    "the and for with from this that your here example sample test demo dummy placeholder change secret password token key value user name admin data file "
    "image page index main class method function config default build version release module package service client server update delete create insert select "
    "public private static final string number value list array table column document report summary archive backup download upload assets images style script "
    "about account action active address after again all also amount another answer apply author base before between block body book button cache call case category change check "
    "child city code color command comment common company content context control copy country current custom customer date default detail device display domain edit email empty "
    "enable end error event field filter find first folder form format found from global group handler have header help history home host info input item just know language last "
    "left level library life line link load local location login long look make manager market may member menu message mobile model module month more most move music network never "
    "new news next node note object office only open option order other output over part people person phone photo place plan play point policy post price print process product"
).split()
_WORDS = "(?i)(?:" + "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))) + ")"
SECRET_AT = 0.5

FEATURES = {
    "f_len": "length(value)",
    "f_digit": "regexp_count(value, '[0-9]') / length(value)",
    "f_upper": "regexp_count(value, '[A-Z]') / length(value)",
    "f_other": "regexp_count(value, '[^A-Za-z0-9]') / length(value)",
    "f_hex": "cast(value rlike '^[0-9a-f]+$' as double)",
    "f_number": "cast(value rlike '^[0-9.+-]+$' as double)",
    "f_changes": "regexp_count(value, '[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])') / length(value)",
    "f_vowels": "regexp_count(value, '(?i)[bcdfghjklmnpqrstvwxz](?=[aeiou])|[aeiou](?=[bcdfghjklmnpqrstvwxz])') / length(value)",
    "f_same": r"regexp_count(value, '(.)(?=\\1)') / length(value)",
    "f_words": f"1 - length(regexp_replace(value, '{_WORDS}', '')) / length(value)",
    "f_path": r"cast(word rlike '://|^[.~]?/|/[^/]+/|\\.(?:html?|js|css|png|jpe?g|py|txt|json|xml|md)\\b' as double)",
    "f_uuid": "cast(value rlike '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}' as double)",
    "f_prefix": "cast(value rlike '^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[a-z]-|eyJ|AIza|glpat-|npm_|hf_)' as double)",
    "f_label": f"cast(before rlike '{_LABEL}' or word rlike '(?:{_LABEL[4:]})[^A-Za-z0-9]*[:=]' as double)",
    "f_assign": "cast(before rlike '(?:[:=]|=>)\\\\s*$' or word rlike '^[A-Za-z_-]+[\"'']?[:=]' as double)",
    "f_innocent": f"cast(before rlike '{_INNOCENT}' as double)",
    "f_quote": "cast(word rlike '[\"''`]' as double)",
}


def labelled_findings(seed: int = 1, each: int = 60) -> list[tuple[str, str, str, str, int]]:
    """(word, value, before, after, secret) made by rule: what findings of either kind look like."""
    r = random.Random(seed)

    def some(chars: str, low: int, high: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(low, high)))

    hexs, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    plain = ["of", "the", "then", "onre", "note:", "see", "entier", "und", "para", "with", ""]
    labels = ["token =", "secret =", "api_key:", "access_key =", "password =", "auth token:", "private_key =", "Bearer", "API key is", "credential:"]
    rows = []

    def add(value: str, before: str, secret: int, word: str | None = None) -> None:
        quote = r.choice(["", '"', "'"])
        rows.append((word or f"{quote}{value}{quote}", value, f"{r.choice(plain)} {before}".strip(), r.choice(plain), secret))

    for _ in range(each):
        label = r.choice(labels)
        add(some(hexs, 40, 40), label, 1)
        add(some(hexs, 32, 64), label, 1)
        add(some(alnum, 20, 44), label, 1)
        add(some(alnum + "+/", 28, 60) + "=", label, 1)
        add(r.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + string.digits, 16, 16), r.choice([label, *plain]), 1)
        # beginnings in two parts: no text of this repository looks like a credential
        add(r.choice(["gh" + "p_", "sk" + "-", "xox" + "b-", "glp" + "at-", "h" + "f_"]) + some(alnum, 24, 40), r.choice([label, *plain]), 1)
        add("ey" + "J" + some(alnum, 20, 60) + "." + some(alnum, 20, 60), r.choice([label, *plain]), 1)
        value = some(alnum + "!#%", 9, 20)
        add(value, r.choice(["password =", "passwd:", "secret ="]), 1)
        value = some(alnum, 16, 32)
        key = r.choice(["token", "secret", "api_key", "password"])
        add(value, r.choice(plain), 1, f'{key}="{value}"')
        # findings that are not secrets
        add(some(hexs, 40, 40), r.choice(["commit", "sha1", "checksum:", "hash of", "revision"]), 0)
        add(some(hexs, 32, 64), r.choice(["md5:", "sha256:", "digest =", *plain]), 0)
        u = some(hexs, 32, 32)
        add(f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", r.choice(["id =", "uuid:", "request", *plain, label]), 0)
        add(some("0123456789", 16, 20), r.choice(["card", "account", "order", *plain]), 0)
        parts = [r.choice(DICTIONARY) for _ in range(r.randint(3, 5))]
        add("_".join(parts) + str(r.randint(1, 99)), r.choice(["see", "file", *plain, label]), 0)
        add("".join(p.capitalize() for p in parts) + str(r.randint(1, 99)), r.choice([*plain, "class"]), 0)
        path = "/".join(parts) + f"/v{r.randint(1, 9)}.html"
        add(path, r.choice(plain), 0, r.choice(["/", "https://host.example/"]) + path)
        add(r.choice(["your-api-key-here-1", "xxxxxxxxxxxxxxxxxxx0", "changeme-password-1", "example-token-000000", "<token-goes-here-1>", "0000000000000000000a"]), label, 0)
        add(f"{r.randint(1, 20)}.{r.randint(0, 20)}.{r.randint(0, 99)}-build.{r.randint(1, 999999)}", r.choice(["version", "release", *plain]), 0)
        add(r.choice(["in", "un", "er"]) + "".join(r.choice(["tion", "ing", "eau", "keit", "lich", "ment"]) for _ in range(4)) + str(r.randint(1, 9)), r.choice([*plain, label]), 0)
    return rows


def described(found: DataFrame) -> DataFrame:
    """found (word, value, before, after, ...) with the features."""
    return found.select("*", *[F.expr(f"cast({sql} as double)").alias(name) for name, sql in FEATURES.items()])


def train(spark: SparkSession, findings: DataFrame | None = None) -> list:
    """The forest; findings (word, value, before, after, secret) must be a bounded table."""
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "word string, value string, before string, after string, secret int")
    rows = described(findings).select(*FEATURES, "secret").collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows])
    return forest.fit(x, np.array([r["secret"] for r in rows], float))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word_at, word, value, before, after) of every candidate. word_at counts words, of which one may hold several candidates."""
    text = F.col(text_col)
    named = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(NAMED)  # plain searches spare most texts the patterns
    block = F.contains(text, F.lit("PRIVATE KEY")) & text.rlike(BLOCK)
    holds = docs.where(text.rlike(LONG) | named | block).select(F.col(id_col).alias("doc_id"), text.alias("t"))
    held = F.transform(F.regexp_extract_all("t", F.lit(BLOCK), F.lit(0)), lambda b: F.concat(F.lit(" "), F.translate(b, _SPACES, _HELD), F.lit(" ")))
    around = F.zip_with(F.split("t", BLOCK), held, lambda part, block: F.concat(part, F.coalesce(block, F.lit(""))))
    words = F.split(F.when(F.col("t").rlike(BLOCK), F.array_join(around, "")).otherwise(F.col("t")), WHITE)
    pieces = lambda x: F.when(x.startswith("-----BEGIN"), F.array(x)).otherwise(F.filter(F.split(x, _BETWEEN), lambda p: (p != "") | (x == "")))
    holds = holds.select("doc_id", F.flatten(F.transform(words, lambda x, i: F.transform(pieces(x), lambda p: F.struct(p.alias("p"), i.alias("i"))))).alias("pi"))
    holds = holds.select("doc_id", F.transform("pi", lambda x: F.translate(x["p"], _HELD, _SPACES)).alias("w"), F.col("pi.i").alias("at"))
    named = rf"(?:{_LABEL[4:]})"

    def is_candidate(i: Column) -> Column:
        word = F.get("w", i)
        one, two = F.get("w", i - 1), F.get("w", i - 2)
        label = rf"(?i){named}\w{{0,40}}[\"']?\s*"
        after_label = (F.length(word) >= 8) & (one.rlike(label + "(?:[:=]|=>|:=)$") | (one.isin("=", ":", ":=", "=>") & two.rlike(label + "$")))
        return word.rlike(BLOCK) | word.rlike(LONG) | word.rlike(NAMED) | F.coalesce(after_label, F.lit(False))

    found = F.filter(F.sequence(F.lit(0), F.size("w") - 1), is_candidate)
    rows = holds.where(F.size("w") > 0).select("doc_id", "w", "at", F.explode(found).alias("k"))
    word = F.get("w", F.col("k"))
    before = F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("k") - 2), F.least(F.col("k"), F.lit(3))), " ")
    rows = rows.select("doc_id", F.get("at", F.col("k")).alias("word_at"), word.alias("word"), before.alias("before"), F.coalesce(F.get("w", F.col("k") + 1), F.lit("")).alias("after"))
    inner = F.regexp_replace("word", r"^(?:[A-Za-z_-]+[\"']?(?:[:=]|=>|:=)|[A-Za-z_][A-Za-z0-9_.-]*[\"']?(?:=>|:=|[:=])(?=[\"'`]))?[\"'`(<\[{]*", "")
    inner = F.regexp_replace(inner, r"^([^\"'`]{8,})[\"'`][^A-Za-z0-9\"'`]*$", "$1")  # up to its closing quote, whatever marks follow
    trimmed = F.regexp_replace(inner, r"(?<![\"'`)>\]},.;:!?])[\"'`)>\]},.;:!?]*+$", "")
    value = F.when(F.col("word").rlike(BLOCK), F.regexp_extract("word", BLOCK, 0)).when(F.regexp_extract("word", f"({LONG})", 1) != "", F.regexp_extract(trimmed, r"^\S*$", 0)).otherwise(trimmed)
    return rows.withColumn("value", value).where(F.length("value") >= 8)


def scan(docs: DataFrame, model: list | None = None) -> DataFrame:
    """(doc_id, word_at, n_chars, value_sha256, score, is_secret) of every candidate."""
    model = model or train(docs.sparkSession)
    scored = described(candidates(docs)).withColumn("score", F.when(F.col("value").rlike(BLOCK), 1.0).otherwise(forest.expression(model, list(FEATURES))))
    return scored.select("doc_id", "word_at", F.length("value").alias("n_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", (F.col("score") >= SECRET_AT).alias("is_secret"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
