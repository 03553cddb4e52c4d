"""Quality classifier: hashed word n-grams, follow-the-regularised-leader updates, sparse dot products.

A text is the set of its hashed words and word pairs (ASCII letters in lower
case; a word twice in a row is one pattern whatever the word).  Training sees
a bounded sample of labelled rows outside the held-out fold, one row at a
time; L1 keeps most weights at 0.  Scoring is one gather and running sum over
the distinct ids of each whole text, in Arrow batches, without a shuffle.

Defined cases: a null text is an empty one and scores the bias alone; a null
id is kept and never held out; without any labelled row every score is 0.5;
equal rows are scored alike, each; an empty table gives no rows; a text of any
length counts with the set of its words and pairs; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import linear as L
from .store import table
from .training import SAMPLE_ROWS, fit_in_task, fold_of, labelled, share

BITS = 18
FAMILIES = {"word_ns": (1, 2)}
PREDICT_AT = 0.3


def _rows(column) -> list[np.ndarray]:
    out = []
    for _, _, t in K.slices(pa.record_batch([column.combine_chunks()], ["text"])):
        first, ids = L.present(L.bags(t, BITS, **FAMILIES), BITS)
        out += [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _fit(sample: pa.Table) -> dict[str, np.ndarray]:
    rows = [(ids, np.ones(len(ids), np.float32)) for ids in _rows(sample["text"])]
    y = sample["y"].to_numpy().astype(np.float64)
    bias, w = L.fit_ftrl(rows, y, len(FAMILIES["word_ns"]) << BITS)
    return {"bias": np.array([bias]), "weights": w.astype(np.float32)}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Bias and weights; labels has doc_id and quality."""
    return fit_in_task(labelled(docs, labels, "quality", sample_rows), _fit)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score) of every row of docs by a model of its labelled rows."""
    return score_with(docs, fit(docs, labels, sample_rows))


def score_with(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    model = share(docs, model)

    def task(batches):
        m = model.value
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            for a, b, t in K.slices(batch) if m else ():
                first, ids = L.present(L.bags(t, BITS, **FAMILIES), BITS)
                p[a:b] = L.sigmoid(m["bias"][0] + K.per_doc_sum(m["weights"][ids].astype(np.float64), first))
            yield pa.record_batch([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(K.tidy(task), "doc_id bigint, score double")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    got = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
