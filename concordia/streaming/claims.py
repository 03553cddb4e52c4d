"""Claims as a stream.

A slot's state is a set of triples, so neither the order of arrival nor a
repeated delivery changes it: the batch definitions run as they are on a
stream, and late rows need no special care.  State grows with the number of
distinct triples; ``watermark`` bounds it by forgetting, and gives up that
guarantee for rows later than it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..plans.store import shared_folder


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stream over the Parquet files of one table of a folder."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)


def distinct_claims(opinions: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each (keys, value, source, evidence) once."""
    if watermark:
        opinions = opinions.withWatermark(*watermark)
        return opinions.dropDuplicatesWithinWatermark([*keys, "value", "source", "evidence"])
    return opinions.dropDuplicates([*keys, "value", "source", "evidence"])


def slot_decisions(opinions: DataFrame, keys: list[str], score: str = "egalitarian") -> DataFrame:
    """Running decisions (complete or update mode): the set of triples is the aggregate, deciding is an expression."""
    item = F.struct(F.col("value").cast("string").alias("value"), F.col("source").cast("string").alias("source"), F.col("evidence").cast("int").alias("evidence"))
    state = opinions.groupBy(*keys).agg(F.collect_set(item).alias("state"))
    best = state.select(*keys, E.winners(F.col("state"), score).alias("_v"), F.size("state").cast("long").alias("n_items"))
    return best.select(*keys, E.decision_of(F.col("_v")).alias("d"), "n_items").select(*keys, "d.*", "n_items")


def windowed_decisions(opinions: DataFrame, ts: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Decisions within event-time windows; a window is final once the watermark passes it."""
    item = F.struct(F.col("value").cast("string").alias("value"), F.col("source").cast("string").alias("source"), F.col("evidence").cast("int").alias("evidence"))
    state = opinions.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), *keys).agg(F.collect_set(item).alias("state"))
    best = state.select(F.col("window.start").alias("window_start"), *keys, E.winners(F.col("state")).alias("_v"))
    return best.select("window_start", *keys, E.decision_of(F.col("_v")).alias("d")).select("window_start", *keys, "d.*")


def run_to_end(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Everything the stream has now, as a table in the shared folder; nothing of it passes the driver.

    append: files of a streaming sink; update: every change, a folder for each
    batch, so a repeated batch replaces itself; complete: the last batch.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{at}/state")
    if mode == "append":
        q = writer.format("parquet").option("path", f"{at}/rows").start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")
        done.append(number)

    q = writer.foreachBatch(keep).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    wanted = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{at}/rows/batch={n}" for n in wanted])


def fold_in_arrival_order(batches: list[DataFrame], keys: list[str], representation: str, score: str = "egalitarian") -> DataFrame:
    """Batches folded one after the other, re-represented after each: with MAX or COUNT the result depends on their order."""
    keep = E.REPRESENTATIONS[representation]
    acc = None
    for batch in batches:
        item = F.struct(F.col("value").cast("string").alias("value"), F.col("source").cast("string").alias("source"), F.col("evidence").cast("int").alias("evidence"))
        new = batch.groupBy(*keys).agg(F.collect_set(item).alias("_new"))
        if acc is None:
            acc = new.withColumnRenamed("_new", "state")
        else:
            empty = F.array().cast(E.STATE)
            met = acc.join(new, keys, "full")
            union = F.array_union(F.coalesce("state", empty), F.coalesce("_new", empty))
            acc = met.select(*keys, keep(union, score).alias("state"))
    return acc.select(*keys, E.decision_text(E.winners(F.col("state"), score)).alias("decision"))


def stateful_decisions(opinions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decision, n_items) whenever a slot's decision changes: a map of triples and a map of scores for each slot.

    The same rule as ``slot_decisions`` for consumers that want changes only,
    not every updated slot. Scores are egalitarian.  A trigger reads and writes
    the entries of its own rows and the slot's scores, never the whole state.
    Maps need the RocksDB state store, which this sets for the session.
    """
    from ..ship import ship

    spark = opinions.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(opinions.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", decision string, n_items long"
    return opinions.select(*keys, F.col("value").cast("string"), F.col("source").cast("string"), F.col("evidence").cast("int")).groupBy(*keys).transformWithStateInPandas(_slot_processor(keys), out, "Update", "None")


def _slot_processor(keys: list[str]):
    from pyspark.sql.streaming import StatefulProcessor

    class SlotProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.triples = handle.getMapState("triples", "value string, source string, evidence int", "seen boolean")
            self.scores = handle.getMapState("scores", "value string", "score long")
            self.decided = handle.getValueState("decided", "decision string, n_items long")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names that Spark calls
            import pandas as pd

            before, n = self.decided.get() if self.decided.exists() else ("", 0)
            for frame in rows:
                for triple in zip(frame["value"], frame["source"], frame["evidence"].astype(int), strict=True):
                    triple = (str(triple[0]), str(triple[1]), int(triple[2]))
                    if self.triples.containsKey(triple):
                        continue
                    self.triples.updateValue(triple, (True,))
                    n += 1
                    held = self.scores.getValue((triple[0],)) if self.scores.containsKey((triple[0],)) else (0,)
                    self.scores.updateValue((triple[0],), (held[0] + (1 << (triple[2] - 1) if 1 <= triple[2] <= 4 else 0),))
            scores = {k[0]: v[0] for k, v in self.scores.iterator()}
            best = sorted(v for v, score in scores.items() if score == max(scores.values()))
            now = f"resolved:{best[0]}" if len(best) == 1 else "disputed:" + ",".join(best)
            self.decided.update((now, n))
            if now != before:
                yield pd.DataFrame({**{k: [x] for k, x in zip(keys, key, strict=True)}, "decision": [now], "n_items": [n]})

        def close(self) -> None:
            pass

    return SlotProcessor()
