"""Byte-level BPE encoding and decoding (operator 5).

Each match of the split pattern is encoded on its own.  A segment tree over the
byte positions of a piece keeps, at its root, the lowest rank of a live pair and
the leftmost position that has it; a merge updates the leaf of the merged
position, of its left neighbour and of the position that is swallowed, each in
logarithmic time.  Ids are packed as little-endian unsigned 32-bit integers.

Defined cases: a null or empty text has no tokens; repeated rows give repeated
results; any other column passes through; an empty table gives an empty one.
Memory: one Arrow batch, plus at most about ``CACHE_PIECES`` cached pieces (some
100 MB) a worker, which the pipeline's stage drops at the end of each task.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from glyphlake.llm.common import as_bytes, chunks, table, tidy

#: Encoded pieces that a worker keeps; the cache starts anew when it is full.
CACHE_PIECES = 250_000
#: Pieces up to this size advance together as rows of arrays; longer ones one by one.
LOCKSTEP_BYTES = 64
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
_NONE = 1 << 62
#: Above every rank.
NO_RANK = 1 << 40
#: Split patterns for which Codec.encode may cut before spaces.
SPACE_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)
#: Characters that may count as white space to one library and not to another.
_EDGES = {"\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\ufeff"}
_STOPS = {".", ",", ";", ":", "!", "?"}
_POSITION = (1 << 32) - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece by the segment tree."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[leaves + i] = r << 32 | i
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += leaves
        if tree[i] == value:
            return
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            a = a if a < b else b
            if tree[i] == a:
                return
            tree[i] = a

    def pair(i: int) -> int:
        j = after[i]
        r = get(piece[i : after[j]]) if j < n else None
        return _NONE if r is None else r << 32 | i

    while tree[1] < _NONE:
        i = tree[1] & _POSITION
        gone = after[i]
        after[i] = j = after[gone]
        if j < n:
            before[j] = i
        put(gone, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairTable:
    """Ranks of pairs of neighbouring tokens, by an open-addressing table of (left id, right id)."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (8 * len(keys) or 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int64)
        todo, value = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(todo)
        while len(todo):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = todo[put], value[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, value, slot = todo[left], value[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens; NO_RANK where there is none."""
        keys = a << 32 | b
        slot = self._slot(keys)
        there = self.keys.take(slot)
        hit = there == keys
        out = np.where(hit, self.values.take(slot), NO_RANK)
        at = np.flatnonzero(~hit & (there >= 0))
        slot = (slot[at] + 1) & self.mask
        while len(at):
            there = self.keys.take(slot)
            hit = there == keys[at]
            out[at[hit]] = self.values[slot[hit]]
            go = ~hit & (there >= 0)
            at, slot = at[go], (slot[go] + 1) & self.mask
        return out


def merge_pieces(pieces: list[bytes], pairs: PairTable, byte_ids: np.ndarray) -> list[bytes]:
    """Packed ids of many pieces of up to LOCKSTEP_BYTES: their segment trees advance together, a merge of each at a time.

    Row r's tree lies at r * 2 * leaves of one flat array, root at 1; a node is
    rank * LOCKSTEP_BYTES + position, so that the least is the leftmost of the lowest rank.
    """
    n = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    leaves = 2
    while leaves < sizes.max():
        leaves *= 2
    shift, low, none = LOCKSTEP_BYTES.bit_length() - 1, LOCKSTEP_BYTES - 1, NO_RANK * LOCKSTEP_BYTES
    inside = np.arange(leaves) < sizes[:, None]
    # One cell beyond each row's end: its id has no pair with anything.
    ids = np.full((n, leaves + 1), -1, np.int64)
    ids[:, :leaves][inside] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    nodes = np.full((n, 2 * leaves), none, np.int64)
    r, i = np.nonzero(inside[:, 1:])
    nodes[r, leaves + i] = pairs.rank(ids[r, i], ids[r, i + 1]) << shift | i
    level = leaves
    while level > 1:
        level //= 2
        nodes[:, level : 2 * level] = np.minimum(nodes[:, 2 * level : 4 * level : 2], nodes[:, 2 * level + 1 : 4 * level : 2])
    wide = leaves + 1
    after = np.broadcast_to(np.minimum(np.arange(1, wide + 1), leaves), (n, wide)).copy().ravel()
    before = np.broadcast_to(np.arange(-1, leaves), (n, wide)).copy().ravel()
    ids, tree = ids.ravel(), nodes.ravel()
    gone_at = []

    def put(base: np.ndarray, i: np.ndarray, value) -> None:
        i = i + leaves
        tree[base + i] = value
        for _ in range(leaves.bit_length() - 1):
            up = i >> 1
            at = base + (up << 1)
            tree[base + up] = np.minimum(tree.take(at), tree.take(at + 1))
            i = up

    row = np.flatnonzero(tree[1 :: 2 * leaves] < none)
    while len(row):
        base, cell = row * (2 * leaves), row * wide
        top = tree.take(base + 1)
        i = top & low
        at = cell + i
        merged = top >> shift
        ids[at] = merged
        gone = after.take(at)
        gone_at.append(cell + gone)
        j = after.take(cell + gone)
        after[at] = j
        before[cell + j] = i
        put(base, gone, none)
        put(base, i, pairs.rank(merged, ids.take(cell + j)) << shift | i)
        k = before.take(at)
        left = np.flatnonzero(k >= 0)
        if len(left):
            k, base = k[left], base[left]
            put(base, k, pairs.rank(ids.take(cell[left] + k), merged[left]) << shift | k)
        row = row[tree.take(row * (2 * leaves) + 1) < none]
    live = np.zeros((n, wide), bool)
    live[:, :leaves] = inside
    if gone_at:
        live.ravel()[np.concatenate(gone_at)] = False
    flat = ids[live.ravel()].astype("<u4").tobytes()
    ends = (np.cumsum(live.sum(1)) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """A vocabulary with its split pattern, and the ids of what a worker has met."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.pieces = regex.compile(pattern)
        #: In a pattern of this form no match crosses a single space between two other characters.
        self.by_space = pattern in SPACE_PATTERNS
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks.get(bytes([c]), 0) for c in range(256)], np.int64)
        self.cache: dict[str, bytes] = {}
        self.open: set[str] = set()
        self.tokens = {v: k for k, v in self.ranks.items()}

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces, those of like length together."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if b in self.ranks:
                self.cache[p] = self.ranks[b].to_bytes(4, "little")
            elif len(b) > LOCKSTEP_BYTES:
                self.cache[p] = b"".join(i.to_bytes(4, "little") for i in merge_piece(b, self.ranks))
            else:
                by_size.setdefault((len(b) - 1).bit_length(), []).append((p, b))
        for group in by_size.values():
            for k in range(0, len(group), 4096):
                part = group[k : k + 4096]
                self.cache.update(zip((p for p, _ in part), merge_pieces([b for _, b in part], self.pairs, self.byte_ids)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = [self.pieces.findall(t) for t in texts]
        new: set[str] = set()
        for pieces in found:
            new.update(pieces)
        self._learn(new.difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in found]

    def _learn_units(self, fresh: set[str]) -> None:
        """Encode new units; those that white space leaves open at an end go to ``open``."""
        parts: list[tuple[str, list[str]]] = []
        need: set[str] = set()
        for u in fresh:
            body = u[1:] if u[:1] == " " else u
            if body.isalpha():
                need.add(u)
            elif body[-1:] in _STOPS and body[:-1].isalpha():
                parts.append((u, [u[:-1], u[-1]]))
            elif body and not body[0].isspace() and not body[-1].isspace() and not _EDGES.intersection((body[0], body[-1])):
                parts.append((u, self.pieces.findall(u)))
            else:
                self.open.add(u)
        for _, pieces in parts:
            need.update(pieces)
        cache = self.cache
        self._learn(need.difference(cache))
        for u, pieces in parts:
            cache[u] = b"".join([cache[p] for p in pieces])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text.

        A text is cut before its spaces; each distinct unit is matched against the
        pattern once.  Where white space meets a cut, the pattern runs over the
        whole text instead.
        """
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
            self.open.clear()
        decoded = [t.decode("utf-8", "replace") for t in texts]
        if not self.by_space:
            return self._whole(decoded)
        cut = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else [" "] for t in decoded]
        new: set[str] = set()
        for units in cut:
            new.update(units)
        new.discard("")
        self._learn_units(new.difference(self.cache, self.open))
        get, out, whole = self.cache.__getitem__, [b""] * len(texts), []
        for k, units in enumerate(cut):
            if not units[0]:
                units = units[1:]
            if self.open and not self.open.isdisjoint(units):
                whole.append(k)
            else:
                out[k] = b"".join(map(get, units))
        for k, ids in zip(whole, self._whole([decoded[k] for k in whole])):
            out[k] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(digest: str, vocabulary, pattern: str) -> Codec:
    """The worker's one codec: kept as long as vocabulary and pattern stay the same."""
    if (digest, pattern) not in _codecs:
        _codecs.clear()
        _codecs[digest, pattern] = Codec(vocabulary.value, pattern)
    return _codecs[digest, pattern]


def _apply(df: DataFrame, path: str, pattern: str, source: str, makes: dict[str, str], keep: bool = True) -> DataFrame:
    """Add binary columns; makes: name -> 'ids' (of the source) or 'bytes' (of the ids, made here or in the source).

    keep: whether a worker keeps what it has met for its next task.
    """
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to executors")
    vocabulary, digest = df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()
    rest = [c for c in df.columns if c not in makes]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, T.BinaryType()) for n in makes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(digest, vocabulary, pattern)
        gc.disable()  # millions of strings and no cycles
        try:
            for b in batches:
                ids = as_bytes(b.column(b.schema.get_field_index(source)))
                made = {}
                for name, what in makes.items():
                    if what == "ids":
                        ids = [x for i, j in chunks(ids) for x in codec.encode(ids[i:j])]
                        made[name] = ids
                    else:
                        made[name] = [codec.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(x, pa.binary()) for x in made.values()], names=[*rest, *made])
        finally:
            gc.enable()
            if not keep:
                _codecs.clear()

    return df.mapInArrow(tidy(run), schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``: the packed ids of ``text``."""
    return _apply(df, path, pattern, text, {into: "ids"})


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the bytes that packed ``ids`` stand for."""
    return _apply(df, path, pattern, ids, {into: "bytes"})


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: bool = True) -> DataFrame:
    """encode() and decode() of what it made, in one pass over the rows."""
    return _apply(df, path, pattern, text, {ids: "ids", decoded: "bytes"}, keep)


def digests(df: DataFrame) -> DataFrame:
    """Token counts and digests of ``_ids`` and ``_decoded``."""
    return df.select(
        "doc_id",
        F.expr("cast(octet_length(_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids="_ids", decoded="_decoded")
    return digests(made.drop("text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digest of what they decode to."""
    import public_tokenizers as P

    made = round_trip(docs.select("doc_id", "text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids="_ids", decoded="_decoded", keep=False)
    return made.select("doc_id", F.expr("cast(octet_length(_ids) div 4 as bigint)").alias("n_tokens"), F.col("_ids").alias("ids"), F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_decoded", 256).alias("decoded_sha256"))
