"""Suffix-array dedup: bytes of strings of ``SPAN`` bytes that start anywhere else too.

*Anchors.*  Of the 137 substrings of 64 bytes in a 200-byte string, the one of
least hash (leftmost of equals) is its anchor; equal strings have equal
anchors at equal places, so strings need to meet only under their anchor's
hash.  Neighbouring windows share an anchor, and form one segment: about one
for 60 bytes.  Anchors are counted by hash (combined before the shuffle).  An
anchor met once says that its windows occur once.  One whose segments are all
alike says that all its windows are repeated.  Only segments of the other
anchors, those where copies begin to differ, need their text.

*Shards.*  Those segments are dealt into bins by anchor.  In a bin, text is cut
into shards.  Each shard has its own Burrows-Wheeler transform, of contexts of
``CONTEXT`` bytes: its suffixes in the order of those bytes, the symbol before
each, and the place of the suffix that begins with that symbol.  The shards'
orders are merged once into an interleave, which is then refined round by
round: read in order, each suffix sends the suffix one symbol longer to the
bucket of its symbol, so the new interleave is in order of one symbol more.
Two neighbours stay in one interval as long as their symbols and the intervals
they came from are the same; the round in which they part is the length of
their common prefix.  Buckets are filled by counting; no suffix is compared or
sorted again.  A suffix alone in its interval is settled and leaves, as does
all that would grow from it, so a round handles what is still repeated.  The
intervals after ``SPAN`` bytes are the repeated strings.  A symbol is as many
bytes as leave at most 65,536 different ones in the bin (8, 4 or 2, so 24 to 96
rounds).

An anchor so common that its segments alone exceed a bin (a passage in a third
of all texts with ever other words around it) is not gathered: its windows
meet by two 64-bit hashes in a combining aggregation, with the same result.

Strings never reach over the end of a text.  Defined cases: null is the empty
text; texts under 200 bytes keep all; rows equal in text are copies of each
other, whatever their ids, and repeated rows too; a null id is kept; an empty
table gives no rows; a long text is read in pieces of ``_PIECE`` bytes that
overlap by a window and may be its own partner; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import kernel as K
from .store import cut, sized_broadcast, table

U64 = np.uint64
SPAN = 200
GRAM = 64
_REACH = SPAN - GRAM + 1  # substrings that compete for a window
_POS = U64(0xFFFFFF)
_PIECE = 1 << 23
#: Text of one bin and of one shard, in bytes.
BIN_BYTES = 1 << 20
SHARD_BYTES = 1 << 18
#: Bytes by which a shard's transform is ordered, and bytes a symbol may have.
CONTEXT = 8
SYMBOL_BYTES = (8, 4, 2)


def _anchors_of(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """hash, segment hash, first and last window start of each anchor (places in buf, at most 2**24 long)."""
    n = len(buf) - GRAM + 1
    if n < _REACH:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    sums = K.prefix_sums(buf)
    at = np.arange(n)
    h = K.span_hash(sums, at, at + GRAM)
    least = (h & ~_POS) | at.astype(np.uint64)
    step = 1
    while step * 2 <= _REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if _REACH > step:
        least = np.minimum(least[: -(_REACH - step)], least[_REACH - step :])
    end = np.repeat(off[1:], np.diff(off))[: len(least)]
    ok = np.flatnonzero(np.arange(len(least)) + SPAN <= end)
    p = (least[ok] & _POS).astype(np.int64)
    new = np.ones(len(ok), bool)
    new[1:] = (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ok)) - 1
    lo, hi, p = ok[first], ok[last] if len(first) else ok[:0], p[first]
    return [h[p], K.mix(K.span_hash(sums, lo, hi + SPAN) ^ K.mix((p - lo).astype(np.uint64))), lo, hi]


def anchors(t: K.Texts) -> list[np.ndarray]:
    """As above for a slice, with the text of each anchor and places within that text."""
    if len(t.buf) <= _PIECE:
        got = _anchors_of(t.buf, t.off)
    else:  # one long text, in pieces that overlap by one window
        parts = []
        for s in range(0, len(t.buf), _PIECE):
            piece = t.buf[s : s + _PIECE + SPAN - 1]
            h, g, lo, hi = _anchors_of(piece, np.array([0, len(piece)]))
            parts.append([h, g, lo + s, hi + s])
        got = [np.concatenate(x) for x in zip(*parts, strict=True)]
    doc = np.searchsorted(t.off, got[2], "right") - 1
    base = t.off[doc]
    return [*got[:2], got[2] - base, got[3] - base, doc]


def text_key(raw: bytes) -> tuple[int, str]:
    d = hashlib.sha256(raw)
    return int.from_bytes(d.digest()[:8], "little", signed=True), d.hexdigest()


def _describe(batches):
    """Rows (doc_id, text) to (doc_id, tk, n_bytes, sha, h, seg, lo, hi)."""
    names = ["doc_id", "tk", "n_bytes", "sha", "h", "seg", "lo", "hi"]
    for batch in batches:
        keys, shas, sizes = [], [], []
        lists: list[list] = [[], [], [], []]
        for _, _, t in K.slices(batch):
            raw = t.buf.tobytes()
            for a, b in zip(t.off[:-1], t.off[1:], strict=True):
                key, sha = text_key(raw[a:b])
                keys.append(key)
                shas.append(sha)
                sizes.append(int(b - a))
            *cols, doc = anchors(t)
            first = pa.array(np.searchsorted(doc, np.arange(len(t) + 1)).astype(np.int32))
            for out, col, kind in zip(lists, cols, (np.int64, np.int64, np.int32, np.int32), strict=True):
                out.append(pa.ListArray.from_arrays(first, pa.array(col.view(np.int64).astype(kind))))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        packed = [pa.concat_arrays(x) if x else pa.array([], pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), *packed], names)


# --- shards --------------------------------------------------------------------


def _contexts(buf: np.ndarray) -> np.ndarray:
    """The CONTEXT bytes from each place on as a number (zeros past the end)."""
    padded = np.concatenate([buf, np.zeros(CONTEXT, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for k in range(CONTEXT):
        out = (out << U64(8)) | padded[k : k + len(buf)]
    return out


def _changes(sorted_keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(sorted_keys), bool)
    out[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return out


def _alphabet(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """(bytes of a symbol, number of the first symbol of each of the ascending contexts)."""
    for n in SYMBOL_BYTES:
        number = np.cumsum(_changes(keys >> U64(8 * (CONTEXT - n)))) - 1
        if not len(number) or number[-1] < 1 << 16:
            break
    return n, number.astype(np.uint16)


def repeated_windows(texts: list[bytes], n_windows: list[int], multiple: list[bool]) -> list[np.ndarray]:
    """For each text, which of its first n_windows starts have a window that occurs twice or more over all texts.

    multiple: a text that stands for several equal ones.
    """
    sizes = np.array([len(x) for x in texts])
    off = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    begin, end = np.repeat(off[:-1], sizes), np.repeat(off[1:], sizes)
    # each shard's suffixes in order of their contexts; a rank counts them over all shards
    context = _contexts(buf)
    places = np.flatnonzero(np.arange(len(buf)) + CONTEXT <= end)
    cuts = off[np.searchsorted(off, np.arange(0, len(buf) + SHARD_BYTES, SHARD_BYTES).clip(max=len(buf)))]
    parts = [places[a:b][np.argsort(context[places[a:b]], kind="stable")] for a, b in itertools.pairwise(np.searchsorted(places, cuts))]
    order = np.concatenate(parts)
    context = context[order]
    # the first interleave: the shards' sorted lists merge by their contexts
    interleave = np.argsort(context, kind="stable").astype(np.int32)
    keys = context[interleave]
    n, number = _alphabet(keys)
    # the transforms: the rank of the suffix one symbol longer (-1: none), and that symbol
    rank = np.full(len(buf), -1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    back = np.where(order - n >= begin[order], rank[np.maximum(order - n, 0)], np.int32(-1))
    symbol = np.zeros(len(order), np.uint16)
    symbol[interleave] = number
    before = symbol[back]  # that of -1 is never read
    weight = np.repeat(np.where(multiple, np.uint8(2), np.uint8(1)), sizes)[order]
    single = not any(multiple)
    parted = _changes(keys)
    depth = CONTEXT
    while len(interleave):
        if single:
            alone = parted & np.append(parted[1:], True)
        else:
            first = np.flatnonzero(parted)
            held = np.add.reduceat(weight[interleave].astype(np.int32), first)
            alone = np.repeat(held == 1, np.diff(np.append(first, len(parted))))
        block = np.cumsum(parted, dtype=np.int32)
        if depth == SPAN:
            interleave = interleave[~alone]
            break
        goes_on = ~alone
        goes_on &= back[interleave] >= 0
        interleave, block = interleave[goes_on], block[goes_on]
        bucket = before[interleave]
        moved = np.argsort(bucket, kind="stable")  # 16 bits: filled by counting
        interleave, block, bucket = back[interleave[moved]], block[moved], bucket[moved]
        parted = _changes(bucket)
        parted[1:] |= block[1:] != block[:-1]
        depth += n
    again = np.zeros(len(buf), bool)
    again[order[interleave]] = True
    return [again[a : a + m] for a, m in zip(off[:-1], n_windows, strict=True)]


def _bin_spans(tab: pa.Table) -> pa.Table:
    """Rows (tk, lo, windows, multi, bytes) of a bin to covered spans (tk, lo, hi)."""
    tab = tab.sort_by([("tk", "ascending"), ("lo", "ascending")])
    tk, lo, n, multi = (tab[k].to_numpy() for k in ("tk", "lo", "windows", "multi"))
    texts = [x.as_py() for x in tab["bytes"]]
    out: list[list] = [[], [], []]
    if texts:
        for i, again in enumerate(repeated_windows(texts, list(n), list(multi))):
            for a, b in runs(np.flatnonzero(again), SPAN):
                out[0].append(tk[i])
                out[1].append(lo[i] + a)
                out[2].append(lo[i] + b)
    return pa.table({"tk": pa.array(out[0], pa.int64()), "lo": pa.array(out[1], pa.int32()), "hi": pa.array(out[2], pa.int32())})


def runs(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows at ascending starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > span)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + span).tolist(), strict=True))


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; touching spans become one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


# --- the operator ----------------------------------------------------------------


def _with_text(need: DataFrame, per_text: DataFrame, n_bytes: float) -> DataFrame:
    """Texts whose (doc_id, key) per_text names; the key is checked where the text is read."""
    return need.join(sized_broadcast(per_text, n_bytes), need["doc_id"].eqNullSafe(per_text["_id"]))


def _union(spans: Column) -> Column:
    """Maximal runs of sorted spans: a text has many anchors but few runs."""
    kind = "array<struct<lo:int,hi:int>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        return F.when((F.size(acc) > 0) & (x["lo"] <= F.get(acc, F.size(acc) - 1)["hi"]), F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, x))

    return F.aggregate(spans, F.array().cast(kind), step)


def _cut_segments(batches):
    """Rows (text, tk, list of (lo, hi, h, multi)) to one row for each segment with its bytes."""
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for text, tk, wanted in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            if text_key(raw)[0] != tk:
                continue
            for w in wanted:
                for col, v in zip(cols, (w["h"], tk, w["lo"], w["hi"] - w["lo"] + 1, w["multi"], raw[w["lo"] : w["hi"] + SPAN]), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "tk", "lo", "windows", "multi", "bytes"])


def _hash_windows(batches):
    """Segments (h, tk, lo, windows, multi, bytes) of very common anchors to one row for each window: two hashes and its place."""
    for batch in batches:
        tk, lo, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
        multi = batch.column(4).to_numpy(zero_copy_only=False)
        t = K.texts_of(batch.column(5).cast(pa.large_binary()).view(pa.large_string())) if batch.num_rows else None
        if t is None:
            continue
        rows = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        at = t.off[:-1][rows] + inner
        sums = K.prefix_sums(t.buf)
        a, b = K.span_hash(sums, at, at + SPAN), K.span_hash(sums, at + SPAN // 3, at + 2 * SPAN // 3)
        cols = [a.view(np.int64), b.view(np.int64), tk[rows], (lo[rows] + inner).astype(np.int32)]
        yield pa.record_batch([*map(pa.array, cols), pa.array(multi[rows])], ["a", "b", "tk", "lo", "multi"])


def _common_spans(pieces: DataFrame) -> DataFrame:
    """Covered spans in segments of anchors too common for one bin: windows meet by hash, combined before the shuffle."""
    w = cut(pieces.mapInArrow(K.tidy(_hash_windows), "a bigint, b bigint, tk bigint, lo int, multi boolean"))
    again = w.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("multi").alias("any")).where("n > 1 or any").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    met = w.join(cut(again), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    return met.select("tk", "lo", (F.col("lo") + SPAN).alias("hi"))


def _remove(keep_text: bool):
    def task(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for i, (tk, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = (batch.column(1)[i].as_py() or "").encode()
                if text_key(raw)[0] != tk:
                    continue
                lo, hi = merge_spans(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
                edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (batch.column(0)[i].as_py(), len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(left).hexdigest(), left if keep_text else None)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return task


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept bytes of texts with spans]) of every row."""
    ship(docs.sparkSession)
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = need.mapInArrow(K.tidy(_describe), "doc_id bigint, tk bigint, n_bytes bigint, sha string, h array<bigint>, seg array<bigint>, lo array<int>, hi array<int>")
    all_rows = cut(found.withColumn("row", F.monotonically_increasing_id()))
    copies = cut(all_rows.groupBy("tk").agg(F.count("*").alias("_n"), F.min("row").alias("_first")).where("_n > 1").withColumnRenamed("tk", "_tk"))
    copies = sized_broadcast(copies, 40.0 * copies.count())
    marked = all_rows.join(copies, F.col("tk") == F.col("_tk"), "left").withColumn("multi", F.col("_tk").isNotNull())
    one = marked.where("not multi or row = _first")
    seg = one.select("doc_id", "tk", "multi", F.explode(F.arrays_zip("h", "seg", "lo", "hi")).alias("a")).select("doc_id", "tk", "multi", "a.h", "a.seg", "a.lo", "a.hi")
    met = seg.groupBy("h").agg(F.min("seg").alias("_least"), F.max("seg").alias("_most"), F.count("*").alias("_n"), F.max("multi").alias("_multi"))
    met = cut(met.where("_n > 1 or _multi").select(F.col("h").alias("_h"), (F.col("_least") == F.col("_most")).alias("alike")))
    again = cut(seg.join(met, F.col("h") == F.col("_h")).drop("_h"))
    span = ["doc_id", "tk", "lo", (F.col("hi") + SPAN).alias("hi")]
    whole = again.where("alike and not multi").select(*span)
    differ = again.where("not alike")
    kinds = cut(differ.groupBy("h", "seg").agg(F.min(F.struct("tk", "doc_id", "lo", "hi")).alias("w"), F.count("*").alias("n"), F.max("multi").alias("_any")).withColumn("several", F.expr("n > 1 or _any")))
    several = kinds.where("several").select(F.col("h").alias("_h"), F.col("seg").alias("_seg"))
    same = differ.where("not multi").join(several, (F.col("h") == F.col("_h")) & (F.col("seg") == F.col("_seg"))).select(*span)
    wanted = kinds.groupBy("w.tk", "w.doc_id").agg(F.collect_list(F.struct("h", "w.lo", "w.hi", F.col("several").alias("multi"))).alias("parts"))
    wanted = cut(wanted.select("tk", F.col("doc_id").alias("_id"), "parts"))
    size = wanted.agg(F.sum(F.size("parts")).alias("n"), F.sum(F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["hi"] - p["lo"] + 1 + SPAN)).alias("bytes")).first()
    n_parts, n_bytes = size["n"] or 0, size["bytes"] or 0
    texts = _with_text(need, wanted, 40.0 * n_parts).select("text", "tk", "parts")
    pieces = texts.mapInArrow(K.tidy(_cut_segments), "h bigint, tk bigint, lo int, windows int, multi boolean, bytes binary")
    bins = max(1, -(-n_bytes // BIN_BYTES))
    heavy = cut(kinds.groupBy(F.col("h").alias("_h")).agg(F.sum(F.col("w.hi") - F.col("w.lo") + 1 + SPAN).alias("_size")).where(F.col("_size") > BIN_BYTES).select("_h"))
    n_heavy = heavy.count()
    common = None
    if n_heavy:
        heavy = sized_broadcast(heavy, 16.0 * n_heavy)
        common = _common_spans(pieces.join(heavy, F.col("h") == F.col("_h"), "left_semi").select("h", "tk", "lo", "windows", "multi", "bytes"))
        pieces = pieces.join(heavy, F.col("h") == F.col("_h"), "left_anti")
    shards = pieces.groupBy(F.pmod(F.xxhash64("h"), F.lit(bins)).alias("g"))
    # a segment of several copies is a partner only: its own copies are covered above
    ids = wanted.select(F.col("tk").alias("_tk"), "_id")
    merged = cut(shards.applyInArrow(K.tidy_group(_bin_spans), "tk bigint, lo int, hi int"))
    if common is not None:
        merged = merged.unionByName(common)
    merged = merged.join(sized_broadcast(ids, 24.0 * n_parts), F.col("tk") == F.col("_tk")).select(F.col("_id").alias("doc_id"), "tk", "lo", "hi")
    multi = marked.where("multi").select(F.col("tk").alias("_tk")).distinct()
    spans = whole.unionByName(same).unionByName(merged).groupBy("tk", "doc_id").agg(_union(F.sort_array(F.collect_list(F.struct("lo", "hi")))).alias("spans"))
    spans = cut(spans.join(sized_broadcast(multi, 24.0 * all_rows.count() / 2), F.col("tk") == F.col("_tk"), "left_anti").select(F.col("tk").alias("_key"), F.col("doc_id").alias("_id"), "spans"))
    n_spans = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    hit = _with_text(need, spans, 24.0 * n_spans).select("doc_id", "text", "_key", "spans").mapInArrow(K.tidy(_remove(keep_text)), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    long = F.col("multi") & (F.col("n_bytes") >= SPAN)
    rest = marked.join(sized_broadcast(spans.select("_key"), 16.0 * n_spans), F.col("tk") == F.col("_key"), "left_anti")
    rest = rest.select("doc_id", "n_bytes", F.when(long, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(long, 1).otherwise(zero).cast("long").alias("n_spans"), F.when(long, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    out = rest.unionByName(hit)
    return out if keep_text else out.drop("kept")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
isl AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM rep),
num AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM isl),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM num GROUP BY doc_id, g),
gaps AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS b FROM runs UNION ALL SELECT doc_id, max(hi), 1000000000 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
