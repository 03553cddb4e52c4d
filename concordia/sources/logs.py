"""Reading conversation logs, and the small selection state kept beside them.

``messages`` is the one shape that everything else reads:
(session_id, seq, role, source_kind, blocks array<struct<type, text>>).
Text leaves this module's callers only through ``operators.claims.blocks``,
which redacts it.
"""

from __future__ import annotations

import json
import logging
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,text:string>>"
EVENT_SCHEMA = f"session_id string, seq bigint, event_type string, data struct<role:string,content:{BLOCKS},source:struct<kind:string>>"

# Event types and the role each speaks with (None: dropped).
EVENT_ROLES = {"user/message": "user", "assistant/message": "assistant", "tool/result": "tool", "system/message": None}

_log = logging.getLogger(__name__)


def _readable(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        return found is not None and len(found) > 0
    except Exception:  # noqa: BLE001  a store that does not answer is a source that can't be read
        return False


def read_events(spark: SparkSession, *paths: str, format: str = "json") -> DataFrame:
    """Session events from any number of paths; a path that can't be read is skipped with a warning, and so are files that break on the way."""
    good = [p for p in paths if _readable(spark, p)]
    for p in paths:
        if p not in good:
            _log.warning("source %s can't be read; it is left out", p)
    if not good:
        return spark.createDataFrame([], EVENT_SCHEMA)
    reader = spark.read.schema(EVENT_SCHEMA).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.format(format).load(good)


def quarantined(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line) of JSON lines under paths that are no event: what ``read_events`` reads as nulls."""
    lines = spark.read.text([p for p in paths if _readable(spark, p)]).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    event = F.from_json("line", EVENT_SCHEMA)
    return lines.where(F.length(F.trim("line")) > 0).where(event["session_id"].isNull() | event["event_type"].isNull())


def to_messages(surface: DataFrame) -> DataFrame:
    """Messages from any of the three layouts: rows of messages, rows of events, or a row for each session with ``messages`` or ``events`` as an array."""
    columns = set(surface.columns)
    for name in ("messages", "events"):
        if name in columns:
            each = surface.select("session_id", F.posexplode(name).alias("seq", "x"))
            fields = each.select("x.*").columns
            flat = each.select("session_id", F.col("seq").cast("bigint").alias("seq"), *[F.col(f"x.{c}").alias(c) for c in fields if c not in ("session_id", "seq")])
            return to_messages(flat)
    if "event_type" in columns:
        return events_to_messages(surface)
    if "blocks" in columns:
        kind = F.col("source_kind") if "source_kind" in columns else F.lit(None).cast("string")
        return surface.select("session_id", "seq", "role", kind.alias("source_kind"), "blocks")
    return turns_to_messages(surface)


def events_to_messages(events: DataFrame) -> DataFrame:
    """Events as messages: role by event type, else the role in the data; system events and rows without content go."""
    known = F.col("event_type").isin(*[k for k, v in EVENT_ROLES.items() if v])
    role = F.lit(None).cast("string")
    for name, speaks in EVENT_ROLES.items():
        if speaks:
            role = F.when(F.col("event_type") == name, speaks).otherwise(role)
    rows = events.where("data.content is not null and not (event_type <=> 'system/message')")
    return rows.select("session_id", "seq", F.when(known, role).otherwise(F.col("data.role")).alias("role"), F.col("data.source.kind").alias("source_kind"), F.col("data.content").alias("blocks")).where("role is not null")


def turns_to_messages(turns: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as messages of one text block each."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return turns.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("bigint").alias("seq"), "role", F.lit(None).cast("string").alias("source_kind"), block.alias("blocks"))


def write_blocks(rendered: DataFrame, path: str) -> None:
    """Sink of rendered blocks: one synthetic user message for each group."""
    rendered.select("merge_group", F.lit("user").alias("role"), "text").write.mode("overwrite").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Sink of an experiment's results: one JSON object for each row."""
    results.write.mode("overwrite").json(path)


class Selection:
    """The chosen source ids, in a JSON file. An explicit empty choice is not the same as none."""

    def __init__(self, path: str, default: list[str] | None = None):
        self.path, self.default = Path(path), list(default or [])
        self._chosen: list[str] | None = None
        self.reload()

    def reload(self) -> None:
        self._chosen = None
        if not self.path.exists():
            return
        try:
            found = json.loads(self.path.read_text())
            chosen = found.get("sources")
            self._chosen = None if chosen is None else [str(x) for x in chosen]
        except (ValueError, AttributeError, TypeError):
            _log.warning("selection file %s can't be read; using the default", self.path)

    def get(self) -> list[str]:
        return list(self.default if self._chosen is None else self._chosen)

    def set(self, ids: list[str]) -> None:
        self._chosen = list(dict.fromkeys(ids))
        self._save()

    def add(self, ids: list[str]) -> None:
        self.set([*self.get(), *ids])

    def remove(self, ids: list[str]) -> None:
        self.set([x for x in self.get() if x not in set(ids)])

    def clear(self) -> None:
        self._chosen = None
        self._save()

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"version": 1, "sources": self._chosen}))
        os.replace(part, self.path)
