"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each model after the first also reads the
earlier categories' probabilities.  In training those are out-of-fold: a row's
earlier probability comes from a model that did not see the row, so the later
model learns how far to trust it.  Each link is a logistic regression over the
set of a text's hashed words and word beginnings (punctuation at the end of a
word does not count), with L1, so a long clean text gathers no weight.

The categories are columns of the labels table, each with a label of its own;
none is computed from another.  ``CATEGORIES`` names them for `labels`, which
has two: *unfit* (quality 0), then *toxic*.  A table with more toxicity columns
is a longer chain (``fit``'s categories).  The last category decides; its
threshold is where F-0.5 over the out-of-fold probabilities is largest, as a
filter must leave clean documents alone.

The sample becomes ids in one task (ids of one row only are left out, as L1
would do); the folds of a link and its final model are fitted side by side,
each in a task.

Defined cases: a null or empty text has no words, so its score is that of the
bias, and it is not toxic unless every labelled row is; a null id is kept;
equal rows are scored alike, each; an empty table gives no rows; without
labelled rows nothing is toxic; a label that is null is no training row of that
category; a text of any length counts with the set of its words; all columns
of docs stay in ``drop_toxic``, whatever their names, and ``score`` replaces
input columns named as its own results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernel as K
from . import linear as L
from .store import fresh, quoted, table
from .training import SAMPLE_ROWS, each_in_a_task, fit_in_task, labelled, share

BITS = 18
FAMILIES = {"word_ns": (1,), "prefix_ns": (5, 6, 7), "strip": True}
N_FAMILIES = 4
SIZE = N_FAMILIES << BITS
#: The chain over `labels`: each category and what of a row says it.
CATEGORIES = {"unfit": "1 - quality", "toxic": "toxic"}
FOLDS = 4
#: A filter must leave clean documents alone: precision counts twice as much as recall.
BETA = 0.5
#: Ids that fewer rows of the sample hold are left out of training.
LEAST_ROWS = 2


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _ids(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    return L.present(L.bags(t, BITS, **FAMILIES), BITS)


def _fit_link(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights over hashed ids, then earlier categories; constant for a label that is all 0 or 1."""
    k = earlier.shape[1]
    if y.min(initial=1) == y.max(initial=0):
        return (6.0 if len(y) and y[0] else -6.0), np.zeros(SIZE + k)
    tail = np.arange(SIZE, SIZE + k)
    bags = [(np.concatenate([ids, tail]), np.concatenate([np.ones(len(ids)), e])) for ids, e in zip(rows, earlier, strict=True)]
    return L.fit_ftrl(bags, y, SIZE + k, alpha=1.0, l1=1.0, l2=0.01, epochs=6)


def _margin(rows: list[np.ndarray], earlier: np.ndarray, bias: float, w: np.ndarray) -> np.ndarray:
    return np.array([bias + w[ids].sum() for ids in rows]) + earlier @ w[SIZE:]


def _one_fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, fold: np.ndarray, f: int) -> dict[str, np.ndarray]:
    """Fit f of a link: out-of-fold margins of fold f, or, for the fit after the last fold, the model of all rows. y: NaN is no label."""
    known = ~np.isnan(y)
    use = np.flatnonzero(known & (fold != f))
    bias, w = _fit_link([rows[i] for i in use], earlier[use], y[use])
    out = np.flatnonzero(fold == f)
    return {"bias": np.array([bias]), "weights": w.astype(np.float32), "margin": _margin([rows[i] for i in out], earlier[out], bias, w)}


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS, side_by_side=None) -> dict[str, np.ndarray]:
    """labels: one column of 0, 1 or NaN for each category, in chain order.

    side_by_side(n, work): [work(0), ..., work(n - 1)], here one after the other.
    """
    n, k = labels.shape
    run = side_by_side or (lambda n, work: [work(f) for f in range(n)])
    fold = np.random.default_rng(5).integers(0, folds, n)
    earlier = np.zeros((n, 0))
    biases, weights, oof = [], [], np.full(n, 0.0)
    for c in range(k):
        y, before = labels[:, c], earlier
        fits = run(folds + 1, lambda f, y=y, before=before: _one_fit(rows, before, y, fold, f))
        oof = np.zeros(n)
        for f in range(folds):
            oof[fold == f] = L.sigmoid(fits[f]["margin"])
        biases.append(fits[folds]["bias"][0])
        weights.append(np.concatenate([fits[folds]["weights"], np.zeros(k - c)]))
        earlier = np.column_stack([earlier, _logit(oof)])
    last = ~np.isnan(labels[:, -1])
    return {"bias": np.array(biases), "weights": np.stack(weights).astype(np.float32), "threshold": np.array([best_threshold(oof[last], labels[last, -1])])}


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = BETA) -> float:
    """Midway in the gap of probabilities where F-beta is largest (0.5 without positives)."""
    if not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f = (1 + beta**2) * hits / (np.arange(1, len(y) + 1) + beta**2 * y.sum())
    q = p[order]
    last = np.append(q[1:] < q[:-1], True)
    at = int(np.argmax(np.where(last, f, -1)))
    below = q[at + 1] if at + 1 < len(q) else 0.0
    return float((q[at] + below) / 2)


def _features(sample: pa.Table) -> dict[str, np.ndarray]:
    """The sample as ids that LEAST_ROWS rows or more hold (ids, first) and labels."""
    first, ids = [np.zeros(1, np.int64)], []
    for _, _, t in K.slices(pa.record_batch([sample["text"].combine_chunks()], ["text"])):
        f, i = _ids(t)
        first.append(f[1:] + first[-1][-1])
        ids.append(i)
    first, ids = np.concatenate(first), np.concatenate(ids)
    keep = np.bincount(ids, minlength=SIZE)[ids] >= LEAST_ROWS
    kept = np.concatenate([[0], np.cumsum(keep)])
    names = [c for c in sample.column_names if c.startswith("y_")]
    y = np.stack([sample[c].cast(pa.float64()).fill_null(float("nan")).to_numpy() for c in names], axis=1)
    return {"ids": ids[keep], "first": kept[first], "y": y}


def chain_probabilities(first: np.ndarray, ids: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """One column of probabilities for each category."""
    k = len(m["bias"])
    p, feed = np.zeros((len(first) - 1, k)), np.zeros((len(first) - 1, 0))
    for c in range(k):
        w = m["weights"][c]
        z = m["bias"][c] + K.per_doc_sum(w[ids].astype(np.float64), first) + feed @ w[SIZE : SIZE + c]
        p[:, c] = L.sigmoid(z)
        feed = np.column_stack([feed, _logit(p[:, c])])
    return p


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, categories: dict[str, str] = CATEGORIES) -> dict[str, np.ndarray]:
    """The chain over categories (name -> SQL of a 0/1 value over labels), the deciding one last."""
    sample = labelled(docs, labels, {f"y_{n}": F.expr(sql) for n, sql in categories.items()}, sample_rows)
    x = fit_in_task(sample, _features)
    if not x:
        return {}
    shared = share(docs, (x["ids"], x["first"]))

    def side_by_side(n, work):
        return each_in_a_task(docs.sparkSession, n, work)

    return fit_chain(_Rows(shared), x["y"], side_by_side=side_by_side) | {"names": np.array(list(categories))}


class _Rows:
    """The sample's rows, read from a broadcast where they are used."""

    def __init__(self, shared):
        self.shared = shared

    def __getitem__(self, i: int) -> np.ndarray:
        ids, first = self.shared.value
        return ids[first[i] : first[i + 1]]


def score(docs: DataFrame, model: dict[str, np.ndarray], names: list[str] | None = None) -> DataFrame:
    """Every row and column of docs, and at its end p_<category> for each category and toxic (or the given names)."""
    known = [str(n) for n in model["names"]] if model else list(CATEGORIES)
    new = names or [f"p_{c}" for c in known] + ["toxic"]
    docs = docs.drop(*new)
    shared = share(docs, {k: v for k, v in model.items() if k != "names"})

    def task(batches):
        m = shared.value
        for batch in batches:
            p, toxic = np.zeros((batch.num_rows, len(new) - 1)), np.zeros(batch.num_rows, bool)
            for a, b, t in K.slices(batch) if m else ():
                p[a:b] = chain_probabilities(*_ids(t), m)
                toxic[a:b] = p[a:b, -1] >= m["threshold"][0]
            extra = [pa.array(np.ascontiguousarray(p[:, c])) for c in range(len(new) - 1)] + [pa.array(toxic)]
            yield pa.record_batch([*batch.columns, *extra], [*batch.schema.names, *new])

    schema = StructType(list(docs.schema))
    for c in new:
        schema = schema.add(c, "boolean" if c == new[-1] else "double")
    return docs.mapInArrow(K.tidy(task), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents found toxic; all columns kept."""
    new = fresh(docs, *[f"p_{c}" for c in CATEGORIES], "toxic")
    scored = score(docs, fit(docs, labels), new)
    return scored.where(~F.col(new[-1])).select(*quoted(docs.columns))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "toxic", F.col("p_toxic").alias("score"), "p_unfit")
