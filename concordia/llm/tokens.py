"""Encoding and decoding with a SentencePiece BPE vocabulary by a table over prefixes.

A token sequence is what merging by rank would give exactly when each adjacent
pair is what merging would give for the two tokens' joined text.  So each
prefix of a text has one last token: of the vocabulary's matches ending there
(one pass of an Aho-Corasick automaton), the one whose pair with the last
token of the prefix before it is compatible.  The table holds that token for
each prefix; ids are read backwards from the end.  A pair's compatibility is
found once by merging its joined text and remembered.

No piece holds the space mark behind another character, nor a character that
falls back to bytes, nor joins most punctuation to other characters, so no
token crosses such a place: a text is cut there into segments, and a bounded cache holds the segments met by a worker.

Defined cases: a null text is empty and has no ids; a mark in the text itself
counts as a space, as in the library; characters outside the vocabulary become
their UTF-8 bytes; a null id is kept; equal rows are encoded each; an empty
table gives no rows; a long text is encoded whole, in memory that grows with
it, and leaves a worker in a batch of its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import HELD, tidy
from .store import table
from .training import share

MARK = "▁"
#: Segments in each half of a worker's cache; when the newer half is full the older one is forgotten.
CACHE = 200_000
#: Pairs of tokens whose compatibility is remembered; when there are more they are found anew.
PAIRS = 600_000
#: Characters of the longest segment that the cache holds, so that its entries bound its bytes.
CACHED_CHARS = 48
#: Characters after which a worker hands on what it has.
PIECE_CHARS = 1 << 20
_BYTE = -1  # in the table: a character that fell back to bytes


@dataclass(frozen=True)
class Vocabulary:
    """Pieces (normal ones) with ids and merge ranks, and the id of each byte."""

    ids: dict[str, int]
    rank: dict[str, float]
    bytes_: tuple[int, ...]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file (driver side; the result is what executors get)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, rank, bytes_ = {}, {}, [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(piece[1:-1], 16)] = i
        elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
            ids[piece] = i
            rank[piece] = -sp.get_score(i)
    return Vocabulary(ids, rank, tuple(bytes_))


def merge_by_rank(text: str, rank: dict[str, float], made: dict[str, tuple[str, str]] | None = None) -> list[str]:
    """Merging as defined: the best ranked adjacent pair, leftmost first, until none is a piece.

    made: gets the two parts of the last merge if one piece is left.
    """
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        if made is not None and len(parts) == 2:
            made[text] = (parts[0], parts[1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Cache(dict):
    """A dictionary that finds what it misses by a function."""

    def __init__(self, find):
        super().__init__()
        self._find = find

    def __missing__(self, key):
        return self._find(key)


@dataclass
class Codec:
    vocabulary: Vocabulary
    _pairs: dict[tuple[str, str], bool] = field(default_factory=dict)
    _older: dict[str, tuple[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        self._cache = _Cache(self._both)
        self._match = ahocorasick.Automaton()
        for piece in v.ids:
            self._match.add_word(piece, piece)
        self._match.make_automaton()
        self._chars = {p for p in v.ids if len(p) == 1}
        self._made: dict[str, tuple[str, str]] = {}
        self._alone = {p for p in v.ids if merge_by_rank(p, v.rank, self._made) == [p]}
        self._piece = {i: p for p, i in v.ids.items()}
        self._shown = {i: p.replace(MARK, " ") for i, p in self._piece.items()}
        self._byte = {i: b for b, i in enumerate(v.bytes_)}
        if any(MARK in p.lstrip(MARK) for p in v.ids):
            raise ValueError("a piece holds the space mark behind another character")
        alone = self._standing_apart(v.ids)
        word = f"[^{MARK}\n{alone}]"
        self._cut = re.compile(f"\n|{MARK}+(?:[{alone}]+|{word}*)|[{alone}]+|{word}+" if alone else f"\n|{MARK}+{word}*|{word}+")

    @staticmethod
    def _standing_apart(pieces) -> str:
        """Punctuation that no piece joins to other characters but the mark: texts may be cut around runs of it."""
        chars = {c for p in pieces for c in p if not (c.isalpha() or c.isdecimal())} - {MARK, "\n"}
        while True:
            mixed = {c for p in pieces for a, b in zip(p, p[1:], strict=False) if MARK not in (a, b) and (a in chars) != (b in chars) for c in (a, b)}
            if not mixed & chars:
                return "".join(re.escape(c) for c in sorted(chars))
            chars -= mixed

    def _fits(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a, b: no piece over their border may ever form.

        The merges of both are undone from the last on. At each moment the two
        parts at the border must not be a pair that would merge before either
        takes part in its own next merge; of equal ranks the left one goes first.
        """
        rank, made = self.vocabulary.rank, self._made
        key, until_a, until_b = (a, b), float("inf"), float("inf")
        ok = True
        while True:
            r = rank.get(a + b)
            if r is not None and r < until_a and r <= until_b:
                ok = False
                break
            at_a, at_b = (rank[a] if a in made else -1.0), (rank[b] if b in made else -1.0)
            if at_a < 0 and at_b < 0:
                break
            if at_a > at_b:
                until_a, a = at_a, made[a][1]
            else:
                until_b, b = at_b, made[b][0]
        self._pairs[key] = ok
        return ok

    def segment(self, s: str) -> list[int]:
        """Ids of a segment: fill the table of last tokens, then read it backwards."""
        v = self.vocabulary
        last: list = [None] * (len(s) + 1)
        if not self._chars.issuperset(s):
            for i, ch in enumerate(s):
                if ch not in self._chars:
                    last[i + 1] = _BYTE
        fits = self._pairs
        for end, piece in self._match.iter(s):
            end += 1
            if last[end] is None:
                start = end - len(piece)
                before = last[start] if start else _BYTE
                if before is _BYTE:
                    ok = piece in self._alone
                elif before is None:
                    ok = False
                else:
                    ok = fits.get((before, piece))
                    if ok is None:
                        ok = self._fits(before, piece)
                if ok:
                    last[end] = piece
        out: list[int] = []
        at = len(s)
        while at:
            piece = last[at]
            if piece is _BYTE:
                out += [v.bytes_[b] for b in reversed(s[at - 1].encode())]
                at -= 1
            else:
                out.append(v.ids[piece])
                at -= len(piece)
        out.reverse()
        return out

    def _pieces(self, ids: list[int]) -> str:
        """Text of ids, marks as spaces; runs of bytes as UTF-8, what is not valid as U+FFFD."""
        try:
            return "".join(map(self._shown.__getitem__, ids))
        except KeyError:  # bytes among them
            pass
        out, raw = [], bytearray()
        for i in [*ids, None]:
            b = self._byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i is not None:
                out.append(self._shown[i])
        return "".join(out)

    def _both(self, s: str) -> tuple[str, str]:
        """A segment's ids and text, from the older half of the cache or anew."""
        if len(self._cache) >= CACHE:
            self._older, self._cache = self._cache, _Cache(self._both)
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        got = self._cache.get(s) or self._older.get(s)
        if got is None:
            ids = self.segment(s)
            got = (",".join(map(str, ids)), self._pieces(ids))
        if len(s) <= CACHED_CHARS:
            self._cache[s] = got
        return got

    def digest(self, text: str | None) -> tuple[str, str]:
        """(decimal ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        # a cache that fills up on the way is replaced for the next text
        got = map(self._cache.__getitem__, self._cut.findall(MARK + text.replace(" ", MARK)))
        ids, shown = zip(*got, strict=True)
        return ",".join(ids), "".join(shown)[1:]

    def encode(self, text: str | None) -> list[int]:
        ids = self.digest(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        """Text of any ids of the vocabulary (one leading space is the mark put before the text)."""
        text = self._pieces(ids)
        return text[1:] if text.startswith(" ") else text


def _codec(shared) -> Codec:
    """One codec for each worker and vocabulary, until the worker does something else."""
    key = id(shared.value)
    if HELD.get("codec", (None,))[0] != key:
        HELD["codec"] = (key, Codec(shared.value))
    return HELD["codec"][1]


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids array, decoded text) of every row; without ids and text, their digests."""
    shared = share(docs, load_vocabulary(path))

    def rows_of(ids_of: list[str], shown: list[str], doc_ids: pa.Array) -> pa.RecordBatch:
        n = [x.count(",") + 1 if x else 0 for x in ids_of]
        if ids:
            # numbers are parsed in one pass over the joined ids, not one by one
            flat = np.array(",".join(x for x in ids_of if x).split(","), dtype=np.int32) if any(n) else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            return pa.record_batch([doc_ids, pa.array(n, pa.int64()), lists, pa.array(shown, pa.string())], names)
        sha = [[hashlib.sha256(x.encode()).hexdigest() for x in col] for col in (ids_of, shown)]
        return pa.record_batch([doc_ids, pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in sha)], names)

    def task(batches):
        codec = _codec(shared)
        for batch in batches:
            # output leaves in pieces of bounded size, however long the texts of a batch are
            first, held, ids_of, shown = 0, 0, [], []
            for i, text in enumerate(batch.column(1)):
                joined, back = codec.digest(text.as_py())
                ids_of.append(joined)
                shown.append(back)
                held += len(back)
                if held >= PIECE_CHARS:
                    yield rows_of(ids_of, shown, batch.column(0)[first : i + 1])
                    first, held, ids_of, shown = i + 1, 0, [], []
            if ids_of or not batch.num_rows:
                yield rows_of(ids_of, shown, batch.column(0)[first:])

    names = ["doc_id", "n_tokens", "ids", "decoded"] if ids else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = f"doc_id bigint, n_tokens bigint, {names[2]} {'array<int>' if ids else 'string'}, {names[3]} string"
    return docs.select("doc_id", "text").mapInArrow(tidy(task, keep="codec"), schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
