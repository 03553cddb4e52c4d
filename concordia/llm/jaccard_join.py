"""N-gram Jaccard join: a count-vector R-tree within blocks, and exact verification.

A text is the set of its hashed word n-grams.  Texts with the same set are one
class, so copies never meet.

*Blocks.*  Two sets of sizes up to u with Jaccard t differ in at most
k = 2u (1 - t) / (1 + t) elements.  Hashing elements into more than k groups,
at least one group is alike in both, and its hash is a common signature
(sizes fall into intervals so that both sides agree on k; a text signs for its
own interval and the next).  So no link is lost.  Signatures shuffle as two
longs; those met by more than one class form blocks, and blocks of the same
classes are one.  Signatures that many classes share are found beforehand by
counting those of one class in ``PROBE``; their rows are dealt by class and
signature, so that no task meets a third of all classes under one signature.

*R-tree.*  Elements are hashed into ``GROUPS`` groups and each class is the
point of its group counts.  In a block, a tree over the points keeps the upper
corner and the size range of each node; the sum over coordinates of
min(query, corner) bounds the overlap with anything below, and a node is
entered only if that reaches what the threshold needs.  Classes that survive
this connect into *regions*; no link leaves a region, and texts that merely
share a passage rarely share one.

*Verification.*  In a region, pairs that survive the same tree and are not yet
connected are verified on the sets.  Only classes in regions are read again.

*Size.*  A block or region beyond what one task holds is dealt into chunks.
Each chunk is linked within itself, then one class of each component found,
then chunks against chunks, except where both hold one and the same
component: a group of near copies of any size is linked in chunks of bounded
memory, and no pair of different components is left out.

Defined cases: a null text is empty; empty texts are linked with nothing; a
null id is kept, linked with nothing, and has a null component; rows of equal
id are rows of their own, each in the component of its text; equal rows and
ties are one class; an empty table gives no rows; a long text is one class,
held as eight bytes a shingle by the task that reads it, and its point grows
with it; other columns are not read.  ``drop_near_copies`` tells rows apart by
id and text: of a component the row of smallest id (a null id last, then the
smallest hash of the text) stays; of rows equal in id and text one stays; rows
without words all stay; all columns stay, whatever their names.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import bloom
from . import kernel as K
from .components import components
from .store import BROADCAST_BYTES, cut, fresh, meet, quoted, sized_broadcast, table

U64 = np.uint64
GROUPS = 64
#: Hashings by which a text whose empty groups may hide a link signs before it signs for being bare in all.
ROUNDS = 8
FANOUT = 16
#: Bytes of sets, and of points, that one task holds at once.
SET_BYTES = 12 << 20
POINT_BYTES = 2 << 20
#: A block of more classes than this is not compared with others for being the same.
BLOCK_ROWS = 1 << 18
#: One class in PROBE has its signatures counted beforehand; one met by about HOT_ROWS classes or more is dealt out.
PROBE = 32
HOT_ROWS = 1 << 16


# --- sets and signatures ------------------------------------------------------


def sets(t: K.Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): the distinct n-gram hashes of each text, ascending within a text by 48 bits."""
    low = K.Texts(K.lower_ascii(t.buf), t.off)
    w = K.words(low)
    h, doc = K.shingles(K.span_hash(K.prefix_sums(low.buf), w.start, w.end), w.first, width)
    key = (doc.astype(np.uint64) << U64(48)) | (h >> U64(16))
    order = np.argsort(key)
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(t) + 1))


def intervals(t: float, most: int) -> np.ndarray:
    """Upper ends of size intervals: each reaches from the last end + 1 to that over t."""
    ends = [0]
    past = 0
    while past < 2:  # two more than needed: a text signs for the next interval too
        ends.append(max(ends[-1] + 1, int((ends[-1] + 1) / t + 1e-9)))
        past += ends[-1] > most
    return np.array(ends)


@cache
def groupings(t: float, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, m, rounds) of the size intervals up to number below: most differing elements, number of groups, hashings.

    m - k groups are alike in two sets that link.  A set with that many empty groups is *bare*: they may be
    all that it has in common with another.  m has the slack over k + 1 that costs the fewest signatures, bare
    sets of the smallest size (the likeliest ones) hashed again; one hashing where most would be bare in any.
    """
    ends = intervals(t, 0)
    while len(ends) < below:
        ends = intervals(t, int(ends[-1]))
    ks, ms, rounds = [], [], []
    for tag in range(below):
        k = int((ends[tag] + ends[max(tag, 1) - 1]) * (1 - t) / (1 + t) + 1e-9)
        n = int(ends[max(tag, 2) - 2]) + 1
        slack = np.arange(2 * k + 1)
        m = k + 1 + slack
        empty = np.exp(-n / m)
        deviation = np.sqrt(np.maximum(m * empty * (1 - (1 + n / m) * empty), 1e-9))
        bare = np.array([math.erfc(z) / 2 for z in (slack + 0.5 - m * empty) / (deviation * math.sqrt(2))])
        best = int(np.argmin(m / np.maximum(1 - bare, 1e-3)))
        ks.append(k)
        ms.append(int(m[best]))
        rounds.append(ROUNDS if bare[best] < 0.5 else 1)
    return np.array(ks), np.array(ms), np.array(rounds)


def signatures(h: np.ndarray, first: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of each group of each text, for its own size interval and the next.

    A pair of intervals i and i or i + 1 meets under i + 1, where its sizes sum
    to at most the ends of both.  Two bare texts may have empty groups only in
    common: both sign by further hashings, and who is bare in all of them signs
    for that.
    """
    n = np.diff(first)
    own = np.searchsorted(intervals(t, int(n.max(initial=0))), n)
    most, groups, rounds = groupings(t, -(-(int(own.max(initial=0)) + 2) // 16) * 16)
    sigs, docs = [], []
    every = np.repeat(np.arange(len(n)), n)
    for step in (0, 1):
        tag = own + step
        left, turn = n > 0, 0
        while left.any():
            of = np.flatnonzero(left[every]) if turn else slice(None)
            doc, x = every[of], h[of]
            if turn:
                x = K.mix(x ^ U64(0x9E3779B97F4A7C15 * turn % (1 << 64)))
            m = np.where(left, groups[tag], 0)
            base = np.concatenate([[0], np.cumsum(m)])
            at = base[:-1][doc] + ((x >> U64(20)) % m[doc].astype(np.uint64)).astype(np.int64)
            held = np.bincount(at, minlength=base[-1])
            total = np.zeros(base[-1], np.uint64)
            np.add.at(total, at, K.mix(x ^ U64(0x5851F42D4C957F2D)))
            full = np.flatnonzero(held)
            whose = np.searchsorted(base, full, "right") - 1
            place = K.mix((tag[whose].astype(np.uint64) << U64(40)) + U64(turn << 32) + (full - base[whose]).astype(np.uint64) + U64(1))
            sigs.append(K.mix(total[full] ^ place))
            docs.append(whose)
            left = left & (m - np.bincount(whose, minlength=len(n)) >= m - most[tag])
            turn += 1
            bare = np.flatnonzero(left & (rounds[tag] == turn))
            sigs.append(K.mix((tag[bare].astype(np.uint64) << U64(40)) + U64(0xE0 << 32)))
            docs.append(bare)
            left[bare] = False
    none = np.zeros(0, np.int64)
    return np.concatenate([none.view(np.uint64), *sigs]), np.concatenate([none, *docs])


def _class_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set, without its top bit's sign trouble in comparisons."""
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(K.mix(h + U64(0x1234567)), out=s[1:])
    x = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(K.mix(h ^ U64(0xABCDEF0123)), out=x[1:])
    a, b = s[first[1:]] - s[first[:-1]], x[first[1:]] - x[first[:-1]]
    return K.mix(a ^ K.mix(b + np.diff(first).astype(np.uint64)))


def _points(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's size and group counts as bytes.

    A set of n elements has 64 groups, or as many powers of two more as leave
    at most eight elements a group: with fuller groups the counts of unrelated
    large sets would come too near each other.
    """
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        bits = max(6, (max(n, 1) - 1).bit_length() - 3)
        counts = np.bincount((h[a:b] >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
        top = counts.max()
        kind = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
        out.append(n.to_bytes(8, "little") + bytes([bits, kind().itemsize]) + counts.astype(kind).tobytes())
    return out


def _point(raw: bytes) -> tuple[int, np.ndarray]:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[9]]
    return int.from_bytes(raw[:8], "little"), np.frombuffer(raw, kind, 1 << raw[8], 10).astype(np.int64)


def _coarse(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(axis=1)


def _describe(width: int, t: float):
    """Rows (doc_id, rid, text) to (doc_id, rid, n, c, point, probe).

    n, c: size and key of the set; point: its size and group counts as bytes;
    probe: the signatures of one class in PROBE.
    """

    def task(batches):
        for batch in batches:
            n, keys, points, probes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
            for _, _, texts in K.slices(batch):
                h, first = sets(texts, width)
                n.append(np.diff(first))
                key = _class_keys(h, first)
                keys.append(key.view(np.int64))
                points += _points(h, first)
                probes += [signatures(h[a:b], np.array([0, b - a]), t)[0].view(np.int64) if probed else None for a, b, probed in zip(first[:-1], first[1:], key % U64(PROBE) == 0, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.concatenate(n)), pa.array(np.concatenate(keys)), pa.array(points, pa.binary()), pa.array(probes, pa.list_(pa.int64()))], ["doc_id", "rid", "n", "c", "point", "probe"])

    return task


def _sign(width: int, t: float):
    """Rows (text) to (sig, c); a slice's repeated pairs (copies) once."""

    def task(batches):
        for batch in batches:
            for _, _, texts in K.slices(batch):
                h, first = sets(texts, width)
                keys = _class_keys(h, first)
                keep = np.flatnonzero(np.bincount(np.unique(keys, return_index=True)[1], minlength=len(keys)))
                sig, doc = signatures(h, first, t)
                once = np.isin(doc, keep)
                yield pa.record_batch([pa.array(sig[once].view(np.int64)), pa.array(keys[doc[once]].view(np.int64))], ["sig", "c"])

    return task


_BLOCK = ["b", "c"]


def _blocks(batches):
    """Rows (sig, c, hot) sorted by (hot, sig, c) to (block, c) of blocks with more than one class, each set of classes once a task.

    Rows of a hot signature are one block each signature; this task has some of them only.
    """
    seen: set[int] = set()
    none = np.zeros(0, np.int64)

    def block_rows(sig: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(sig), pa.array(c)], _BLOCK)

    def emit(sig: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        if not len(sig):
            return block_rows(none, none)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
        sig, c = sig[new], c[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        n = np.diff(np.append(start, len(sig)))
        total = np.add.reduceat(K.mix(c.view(np.uint64)), start)
        block = K.mix(total + n.astype(np.uint64)).view(np.int64)
        several = np.zeros(len(start), bool)
        for i in np.flatnonzero(n > 1):
            if int(block[i]) not in seen:
                seen.add(int(block[i]))
                several[i] = True
        if len(seen) > BLOCK_ROWS:
            seen.clear()
        rows = np.repeat(several, n)
        return block_rows(np.repeat(block, n)[rows], c[rows])

    rest = (none, none)
    for batch in batches:
        sig, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        hot = batch.column(2).to_numpy(zero_copy_only=False)
        if hot.any():
            yield block_rows(sig[hot], c[hot])
            sig, c = sig[~hot], c[~hot]
        sig, c = np.concatenate([rest[0], sig]), np.concatenate([rest[1], c])
        if not len(sig):
            continue
        last = int(np.searchsorted(sig, sig[-1]))  # the last block may go on in the next batch
        if last:
            yield emit(sig[:last], c[:last])
        open_ = np.unique(c[last:])
        rest = (np.full(len(open_), sig[-1]), open_)
    yield emit(*rest)


# --- the R-tree ---------------------------------------------------------------


class CountTree:
    """An R-tree packed over points sorted by size; nodes keep upper corners and size ranges."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            p, low, high = self.levels[-1]
            cuts = np.arange(0, len(p), FANOUT)
            self.levels.append((np.maximum.reduceat(p, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def search(self, q: np.ndarray, size: int, t: float, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, bounds) that may overlap enough with q; wanted: which points to report."""
        p, low, high = self.levels[-1]
        at = np.arange(len(p))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, low, high = self.levels[depth]
            if depth == 0:
                at = at[wanted[at]]
            fits = (high[at] >= t * size - 1e-9) & (t * low[at] <= size + 1e-9)
            at = at[fits]
            bound = np.minimum(p[at], q).sum(axis=1)
            ok = bound * (1 + t) >= t * (size + low[at]) - 1e-6
            at, bound = at[ok], bound[ok]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at, bound


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def connect(sizes: np.ndarray, points: np.ndarray, t: float, links, label: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """Component number of each class; links(i, j) decides a pair that survives the tree.

    label: components known before; side: only pairs of different sides meet.
    """
    m = len(sizes)
    comp = np.arange(m)
    if label is not None:
        _, head, back = np.unique(label, return_index=True, return_inverse=True)
        comp = head[back]
    order = np.argsort(sizes, kind="stable")
    tree = CountTree(points[order], sizes[order])
    members: dict[int, list[int]] = {}
    for i, c in enumerate(comp):
        members.setdefault(int(c), []).append(i)
    for rank in range(1, m):
        i = order[rank]
        open_ = np.zeros(m, bool)
        before = order[:rank]
        open_[:rank] = comp[before] != comp[i]
        if side is not None:
            open_[:rank] &= side[before] != side[i]
        if not open_.any():
            continue
        at, bound = tree.search(points[i], int(sizes[i]), t, open_)
        for j in order[at[np.argsort(-bound, kind="stable")]]:
            if comp[i] != comp[j] and links(i, j):
                x, y = int(comp[i]), int(comp[j])
                if len(members[x]) > len(members[y]):
                    x, y = y, x
                comp[members[x]] = y
                members[y] += members.pop(x)
    return comp


def _link_rows(t_num: int, t_den: int, verify: bool):
    """Groups of rows (g, region, c, comp, side, payload) to edges (a, b) that connect what links.

    payload: a set's elements if verify, else its point, and what survives the tree and the bound at
    the finer groups of both links.
    """
    t = t_num / t_den

    def components_of(payload: list[bytes], label: np.ndarray, side: np.ndarray | None) -> np.ndarray:
        if verify:
            found = [np.frombuffer(x, np.uint64) for x in payload]
            sizes = np.array([len(x) for x in found])
            points = np.array([np.bincount((x >> U64(58)).astype(np.int64), minlength=GROUPS) for x in found])

            def links(i, j):
                o = overlap(found[i], found[j])
                return t_den * o >= t_num * (int(sizes[i]) + int(sizes[j]) - o)
        else:
            got = [_point(x) for x in payload]
            fine = [p for _, p in got]
            sizes, points = np.array([n for n, _ in got]), np.array([_coarse(p, GROUPS) for p in fine])

            def links(i, j):
                groups = min(len(fine[i]), len(fine[j]))
                bound = np.minimum(_coarse(fine[i], groups), _coarse(fine[j], groups)).sum()
                return bound * (1 + t) >= t * (sizes[i] + sizes[j]) - 1e-6

        return connect(sizes, points, t, links, label, side)

    def task(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([("region", "ascending"), ("c", "ascending")])
        region, c, comp, side = (tab[k].to_numpy() for k in ("region", "c", "comp", "side"))
        data = tab["payload"].combine_chunks()
        a, b = [], []
        cuts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]])) if len(region) else np.zeros(1, np.int64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            rows = np.arange(s, e)
            rows = rows[np.concatenate([[True], c[s + 1 : e] != c[s : e - 1]])]  # a class counts once
            sides = side[rows]
            got = components_of([data[int(i)].as_buffer().to_pybytes() for i in rows], comp[rows], sides if len(np.unique(sides)) > 1 else None)
            _, head, back = np.unique(got, return_index=True, return_inverse=True)
            lead = rows[head[back]]
            new = lead != rows
            a.append(c[lead[new]])
            b.append(c[rows[new]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return task


# --- the operator -------------------------------------------------------------


def seen_schema(rid: str) -> str:
    return f"doc_id bigint, rid {rid}, n bigint, c bigint, point binary, probe array<bigint>"


def _hot_signatures(named: DataFrame, n_classes: int) -> tuple[DataFrame, int]:
    """(_hot) signatures that about HOT_ROWS classes or more share, as one class in PROBE shows."""
    probes = named.where("probe is not null").select("c", F.explode("probe").alias("_hot")).distinct()
    least = max(HOT_ROWS, n_classes // 32768) // PROBE
    hot = cut(probes.groupBy("_hot").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("_hot"))
    return hot, hot.count()


def _linked(need: DataFrame, width: int, t_num: int, t_den: int) -> tuple[DataFrame, DataFrame]:
    """need: (doc_id not null, rid, text). (rows (doc_id, rid, n, c) with words or without, classes (c, copies, component_id)).

    component_id: the smallest doc_id of the component of texts that link.
    """
    spark = need.sparkSession
    ship(spark)
    t = t_num / t_den
    seen = cut(need.mapInArrow(K.tidy(_describe(width, t)), seen_schema(need.schema["rid"].dataType.simpleString())))
    named = seen.where("n > 0")
    classes = cut(named.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    hot, n_hot = _hot_signatures(named, classes.count())
    signed = need.select("text").mapInArrow(K.tidy(_sign(width, t)), "sig bigint, c bigint")
    signed = signed.join(sized_broadcast(hot, 16.0 * n_hot), F.col("sig") == F.col("_hot"), "left") if n_hot else signed.withColumn("_hot", F.lit(None).cast("long"))
    signed = signed.select("sig", "c", F.col("_hot").isNotNull().alias("hot"))
    dealt = signed.repartition("sig", F.when(F.col("hot"), F.col("c"))) if n_hot else signed.repartition("sig")
    blocks = dealt.sortWithinPartitions("hot", "sig", "c").mapInArrow(K.tidy(_blocks), "b bigint, c bigint")
    blocks = cut(blocks.groupBy("b", "c").agg(F.lit(1).alias("_one")).drop("_one"))
    met = cut(blocks.select(F.col("c").alias("_c")).distinct())
    n_met = met.count()
    per = classes.select("c", "copies", F.col("rep").alias("component_id"))
    if not n_met:
        return seen.select("doc_id", "rid", "n", "c"), per
    points = cut(named.join(sized_broadcast(met, 16.0 * n_met), F.col("c") == F.col("_c"), "left_semi").dropDuplicates(["c"]).select(F.col("c").alias("_c"), "point"))
    n_bytes = points.agg(F.sum(F.length("point") + 32)).first()[0] or 0
    held = blocks.join(sized_broadcast(points, n_bytes), F.col("c") == F.col("_c")).select(F.col("b").alias("region"), "c", F.col("point").alias("payload"))
    near = _link_groups(held, POINT_BYTES, _link_rows(t_num, t_den, verify=False))
    wanted = cut(classes.join(near, F.col("c") == F.col("node")).select("c", "rep", F.col("root").alias("region")))
    texts = need.join(sized_broadcast(wanted.select("rep", "c", "region"), 32.0 * n_met), F.col("doc_id") == F.col("rep"))
    comps = _link_groups(_elements(texts, width), SET_BYTES, _link_rows(t_num, t_den, verify=True))
    reps = classes.select(F.col("c").alias("_c"), "rep")
    labels = cut(comps.join(reps, F.col("node") == F.col("_c")).groupBy("root").agg(F.min("rep").alias("label"), F.count("*").alias("_n")))
    named_comps = meet(comps, labels, "root", "_n", n_met).select(F.col("node").alias("_node"), "label")
    per = per.join(named_comps, F.col("c") == F.col("_node"), "left").select("c", "copies", F.coalesce("label", "component_id").alias("component_id"))
    return seen.select("doc_id", "rid", "n", "c"), per


def link(docs: DataFrame, width: int = 5, t_num: int = 80, t_den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links: t_den * intersection >= t_num * union."""
    all_rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("long").alias("rid"), F.col(text_col).alias("text"))
    seen, per = _linked(all_rows.where("doc_id is not null"), width, t_num, t_den)
    out = meet(seen.where("n > 0").select("doc_id", "n", "c"), cut(per), "c", "copies", seen.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    wordless = seen.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nameless = all_rows.where("doc_id is null").mapInArrow(K.tidy(_describe(width, t_num / t_den)), seen_schema("bigint"))
    return out.unionByName(wordless).unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _elements(texts: DataFrame, width: int) -> DataFrame:
    """(region, c, payload): the set of each class as bytes of ascending longs."""

    def task(batches):
        done: set[int] = set()  # copies that share an id: a class once a task, as far as memory goes
        for batch in batches:
            c = batch.column(1).to_numpy()
            out, keep = [], []
            if len(done) > BLOCK_ROWS:
                done.clear()
            for a, _, t in K.slices(batch):
                h, first = sets(t, width)
                keys = _class_keys(h, first).view(np.int64)
                for i in range(len(t)):
                    if keys[i] == c[a + i] and int(keys[i]) not in done:
                        done.add(int(keys[i]))
                        keep.append(a + i)
                        out.append(np.sort(h[first[i] : first[i + 1]]).tobytes())
            yield pa.record_batch([batch.column(2).take(pa.array(keep, pa.int64())), pa.array(c[keep]), pa.array(out, pa.binary())], ["region", "c", "payload"])

    return texts.select("text", "c", "region").mapInArrow(K.tidy(task), "region bigint, c bigint, payload binary")


_EDGE = "a bigint, b bigint"


def _link_groups(held: DataFrame, limit: int, work) -> DataFrame:
    """(node, root) of classes that link. held: (region, c, payload); only classes of one region may link."""
    held = cut(held)
    sizes = cut(held.groupBy("region").agg(F.sum(F.length("payload")).alias("_bytes")))
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    large = sizes.where(F.col("_bytes") > limit).withColumnRenamed("region", "_r")
    n_large = large.count()
    bins = max(1, -(-int(total) // (limit // 2)))
    small = held
    if n_large:
        large = sized_broadcast(large, 24.0 * n_large)
        small = held.join(large, F.col("region") == F.col("_r"), "left_anti")
    plain = [F.col("c").alias("comp"), F.lit(0).cast("long").alias("side"), "payload"]
    grouped = small.select(F.pmod(F.xxhash64("region"), F.lit(bins)).alias("g"), "region", "c", *plain)
    links = cut(grouped.groupBy("g").applyInArrow(K.tidy_group(work), _EDGE))
    if n_large:
        links = links.unionByName(_link_large(held.join(large, F.col("region") == F.col("_r")).drop("_r"), limit, work))
    return cut(components(links))


def _link_large(big: DataFrame, limit: int, work) -> DataFrame:
    """Edges of regions beyond one task: within chunks, then among one class of each component, then chunk against chunk."""
    half = limit // 2
    weight = F.sum(F.length("payload"))
    side = F.lit(0).cast("long").alias("side")

    def inside(rows: DataFrame, chunks: Column, salt: int) -> DataFrame:
        g = F.xxhash64("region", F.pmod(F.xxhash64("c", F.lit(salt)), chunks)).alias("g")
        return cut(rows.select(g, "region", "c", F.col("c").alias("comp"), side, "payload").groupBy("g").applyInArrow(K.tidy_group(work), _EDGE))

    found = inside(big, F.ceil(F.col("_bytes") / half), 0)
    left = None
    for turn in range(1, 9):  # one class of each component, while that shrinks
        comps = cut(components(found))
        lead = big.join(comps.where("node <> root").select("node"), F.col("c") == F.col("node"), "left_anti")
        per = cut(lead.groupBy("region").agg(weight.alias("_left")).withColumnRenamed("region", "_r"))
        now = per.agg(F.sum("_left")).first()[0] or 0
        if left is not None and now > 0.7 * left:
            break
        left = now
        found = cut(found.unionByName(inside(lead.join(per, F.col("region") == F.col("_r")), F.ceil(F.col("_left") / half), turn)))
    # chunks by component; a pair of chunks that holds one component only is done
    comps = cut(components(found))
    rows = big.join(comps, F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "c")).drop("node", "root")
    heavy = rows.groupBy("region", "comp").agg(weight.alias("_w")).withColumnsRenamed({"region": "_r", "comp": "_k"})
    rows = rows.join(heavy, (F.col("region") == F.col("_r")) & (F.col("comp") == F.col("_k"))).drop("_r", "_k")
    pure = F.col("_w") >= half / 2
    mixed = F.pmod(F.xxhash64("comp"), F.ceil(F.col("_bytes") / half))
    rows = cut(rows.withColumn("pure", F.when(pure, F.col("comp"))).withColumn("chunk", F.when(pure, F.xxhash64(F.lit("pure"), "region", "comp", F.pmod(F.xxhash64("c"), F.ceil(F.col("_w") / half)))).otherwise(F.xxhash64(F.lit("mixed"), "region", mixed))))
    heads = cut(rows.groupBy("region", "chunk").agg(F.first("pure").alias("pure")))
    x, y = (heads.select(F.col("region").alias(f"r{k}"), F.col("chunk").alias(f"x{k}"), F.col("pure").alias(f"p{k}")) for k in (0, 1))
    pairs = x.join(y, (F.col("r0") == F.col("r1")) & (F.col("x0") <= F.col("x1"))).where("p0 is null or p1 is null or p0 <> p1")
    ends = pairs.select("r0", F.xxhash64("x0", "x1").alias("g"), F.explode(F.array_distinct(F.array("x0", "x1"))).alias("at"), (F.col("x0") == F.col("x1")).alias("same"))
    both = rows.join(ends, (F.col("region") == F.col("r0")) & (F.col("chunk") == F.col("at")))
    cross = both.select("g", "region", "c", "comp", F.when(F.col("same"), F.lit(0)).otherwise(F.col("at")).alias("side"), "payload").groupBy("g").applyInArrow(K.tidy_group(work), _EDGE)
    return found.unionByName(cut(cross))


def drop_near_copies(docs: DataFrame, width: int = 5, t_num: int = 80, t_den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of linked texts; all columns kept.

    Only narrow rows (id, hash of the text, class) are grouped.  What becomes
    of them is a table of the rows that go and of rows equal in id and text;
    where it is too large to broadcast, a Bloom filter of it lets all rows that
    surely stay pass in place.
    """
    names = quoted(docs.columns)
    mark = F.xxhash64(text_col)
    need = docs.select(mark.alias("doc_id"), F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    seen, per = _linked(need, width, t_num, t_den)
    n_rows = seen.count()
    rows = cut(meet(seen.where("n > 0").select("rid", F.col("doc_id").alias("mark"), "c"), cut(per), "c", "copies", n_rows).select("rid", "mark", "component_id"))
    order = F.struct(F.col("rid").isNull().alias("none"), F.col("rid").alias("id"), "mark")
    groups = cut(rows.groupBy("component_id").agg(F.min(order).alias("keep"), F.count("*").alias("many")).where("many > 1"))
    stays = (F.col("rid").eqNullSafe(F.col("keep.id"))) & (F.col("mark") == F.col("keep.mark"))
    verdicts = meet(rows, groups, "component_id", "many", n_rows).select("rid", "mark", stays.alias("stays"))
    verdicts = cut(verdicts.groupBy("rid", "mark").agg(F.max("stays").alias("stays"), F.count("*").alias("many")).where("not stays or many > 1"))
    n_verdicts = verdicts.count()
    v_id, v_mark, v_stays, key, perhaps = fresh(docs, "rid", "mark", "stays", "key", "perhaps")
    verdicts = verdicts.select(F.col("rid").alias(v_id), F.col("mark").alias(v_mark), F.col("stays").alias(v_stays))
    small = 40.0 * n_verdicts <= BROADCAST_BYTES
    keyed, alone = docs, None
    if not small:
        m = bloom.slots_for(docs.sparkSession, n_verdicts)
        bits = cut(bloom.build(verdicts.select(F.xxhash64(v_id, v_mark).alias(key)), F.col(key), m, least=1))
        keyed = bloom.tested(docs.withColumn(key, F.xxhash64(id_col, mark)), F.col(key), bits, m, perhaps)
        alone = keyed.where(~F.col(perhaps)).select(*names)
        keyed = keyed.where(F.col(perhaps))
    met = keyed.join(F.broadcast(verdicts) if small else verdicts, F.col(id_col).eqNullSafe(F.col(v_id)) & (mark == F.col(v_mark)), "left")
    out = met.where(F.col(v_stays).isNull()).select(*names)
    if not verdicts.where(F.col(v_stays)).isEmpty():  # of rows equal in id and text the least by all columns
        again = met.where(F.col(v_stays)).groupBy(v_id, v_mark).agg(F.min(F.struct(*names)).alias("least"))
        out = out.unionByName(again.select("least.*"))
    return alone.unionByName(out) if alone is not None else out


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), width=3, t_num=90, t_den=100)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM sh),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN sh si ON si.doc_id = i JOIN sh sj ON sj.doc_id = j WHERE 100 * o >= 90 * (len(si.s) + len(sj.s) - o)),
e AS (SELECT i AS a, j AS b FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id, doc_id AS other FROM sh UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sh JOIN c USING (doc_id)
"""
