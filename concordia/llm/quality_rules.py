"""Quality rules: counts of a text and a calibrated n-gram model against fixed thresholds.

The counts (words, symbols, repeated lines, words in repeated windows) are
exact and come from array passes over the bytes of a batch.  The model is a
logistic regression on shares of hashed words and of character trigrams,
trained on labelled quality rows of folds 2-4; fold 1 calibrates its margin
into a probability (a sigmoid with smoothed targets), and fold 0 is never
seen.  A text is kept when the base rules pass and that probability is at
least ``KEEP_AT``.

Defined cases: a null text has no words and fails the base rules; a null id
is kept as it is; without labelled rows the base rules alone decide; equal
rows are counted each; an empty table gives no rows; a text of any length is
counted whole, in memory that grows with it; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K
from . import linear as L
from .store import table
from .training import SAMPLE_ROWS, fit_in_task, labelled, share

BITS = 18
FAMILIES = {"word_ns": (1,), "char_ns": (3,)}
KEEP_AT = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(t: K.Texts) -> dict[str, np.ndarray]:
    """The five counts of each text of a slice."""
    w = K.words(t)
    n_docs = len(t)
    inside = ~K.IS_SPACE[t.buf]
    point = inside & ((t.buf & 0xC0) != 0x80)
    out = {"n_words": w.per_doc, "word_chars": K.per_doc_sum(point, t.off), "n_symbols": K.per_doc_sum(_SYMBOL[t.buf], t.off)}
    sums = K.prefix_sums(t.buf)
    # lines end at each newline and at the end of a text
    breaks = np.flatnonzero(t.buf == 10)
    begin = np.sort(np.concatenate([t.off[:-1], breaks + 1]))
    own = np.searchsorted(t.off, begin, "right") - 1
    full = own < n_docs
    begin, own = begin[full], own[full]
    stop = np.append(begin[1:], len(t.buf))
    stop = np.minimum(stop, t.off[own + 1])
    stop -= (stop > begin) & (t.buf[np.maximum(stop - 1, 0)] == 10) if len(t.buf) else 0
    with_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop, own = begin[with_word], stop[with_word], own[with_word]
    again = K.earlier_equal(K.span_hash(sums, begin, stop), own)
    out["n_dup_lines"] = np.bincount(own[again], minlength=n_docs)
    # words covered by a window of eight that occurs twice or more
    h = K.span_hash(sums, w.start, w.end)
    key, doc, at = _windows(h, w)
    rep = at[K.in_repeat(key, doc)]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, rep, 1)
    np.add.at(edge, rep + WINDOW, -1)
    out["n_repeat_words"] = K.per_doc_sum(np.cumsum(edge[:-1]) > 0, w.first)
    return out


def _windows(h: np.ndarray, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of each run of eight words within a text."""
    at = np.flatnonzero(np.arange(len(h)) + WINDOW <= w.first[w.doc + 1]) if len(h) else np.zeros(0, np.int64)
    key = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        key = K.mix(key * K.U64(0x9FB21C651E98DF25) + h[at + k])
    return key, w.doc[at], at


def _families(t: K.Texts):
    return L.bags(t, BITS, **FAMILIES)


def _fit(sample: pa.Table) -> dict[str, np.ndarray]:
    rows = []
    for _, _, t in K.slices(pa.record_batch([sample["text"].combine_chunks()], ["text"])):
        rows += L.mean_bags(_families(t), BITS)
    y, fold = sample["y"].to_numpy().astype(np.float64), sample["fold"].to_numpy()
    size = 2 << BITS
    fit, cal = np.flatnonzero(fold > 1), np.flatnonzero(fold == 1)
    if not len(fit):
        fit = cal
    bias, w, _ = L.fit_logistic([rows[i] for i in fit], y[fit], size, l2=1e-6, epochs=10)
    a, b = 1.0, 0.0
    if len(cal):
        a, b = L.fit_platt(np.array([bias + float(w[rows[i][0]] @ rows[i][1]) for i in cal]), y[cal])
    return {"bias": np.array([bias]), "weights": w.astype(np.float32), "platt": np.array([a, b])}


def apply(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, probability) of every row of docs."""
    model = share(docs, fit_in_task(labelled(docs, labels, "quality", sample_rows), _fit))

    def task(batches):
        m = model.value
        for batch in batches:
            parts, probs = [], [np.zeros(0)]
            for a, b, t in K.slices(batch):
                parts.append(counts(t))
                p = np.ones(b - a)
                if m:
                    scale, shift = m["platt"]
                    p = L.sigmoid(scale * L.mean_margin(_families(t), BITS, m["bias"][0], m["weights"]) + shift)
                probs.append(p)
            c = {k: np.concatenate([np.zeros(0, np.int64), *(x[k] for x in parts)]).astype(np.int64) for k in _COUNTS}
            p = np.concatenate(probs)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            yield pa.record_batch([batch.column(0), *(pa.array(c[k]) for k in _COUNTS), pa.array(failed), pa.array(~failed & (p >= KEEP_AT)), pa.array(p)], ["doc_id", *_COUNTS, "base_failed", "kept", "probability"])

    schema = "doc_id bigint, " + ", ".join(f"{k} bigint" for k in _COUNTS) + ", base_failed boolean, kept boolean, probability double"
    return docs.select("doc_id", "text").mapInArrow(K.tidy(task), schema)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
