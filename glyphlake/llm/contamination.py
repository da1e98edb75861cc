"""Benchmark decontamination by SimHash windows (operator 4).

Words as in the near-duplicate operator (A-Z lower-cased).  A benchmark item's
features are its five-word shingles, weighted by how often they occur; its SimHash
has the sign of the weighted sum of the features' bits.  Documents are cut into
windows of item size, a start every ``STRIDES``-th part of it; sizes that differ
by less than ``SIZE_STEP`` share windows.  Fingerprints are split into blocks;
by the pigeonhole principle two within ``RADIUS`` bits agree in one block up to
``RADIUS // blocks`` bits, so a table of every block value to the items that lie
that near finds all items within the radius.  Windows within the radius are then
aligned and verified: shared weight of the item's shingles and the window's, at
PER_CENT of the weight of their union.  Items of fewer than five words are one
shingle and match exact word sequences.

The benchmark is a stated query set against all rows; up to ``MAX_ITEMS`` items
are sent to every task, more of them go in several passes.

Defined cases: a null or empty text has no windows; a text of any length is searched
in overlapping pieces of bounded size; every item that is found counts, so ties need
no order; null items and items without words are left out, equal rows of the
benchmark count once; repeated rows return once each; other columns pass through
whatever their names, but for the new one; an empty table gives an empty one, an
empty benchmark no hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from glyphlake.llm.common import Words, as_bytes, chunks, combine, mix, shield, table, tidy, word_sequence_hash

SHINGLE, PER_CENT = 5, 75
#: Fingerprint blocks of 16 bits, and the radius: an alignment half a stride off and a similarity at the threshold stay within it.
BLOCKS, RADIUS = 4, 20
STRIDES, SIZE_STEP = 8, 1.15
#: Items of one pass (each a few hundred bytes in the tables that tasks get).
MAX_ITEMS = 4096
#: Bytes of text handled at once (about 110 bytes of arrays each); longer texts are cut into pieces that share as many words as an item's windows may reach.
PIECE_BYTES = 1 << 19
_BLANK_RE, _WORD_RE = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")


def pieces(text: bytes, most: int, overlap: int) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes, cut at white space; each has the last ``overlap`` words of the one before."""
    begin = 0
    while len(text) - begin > 2 * most:
        end = begin + most
        while True:
            m = _BLANK_RE.search(text, end)
            end = m.start() if m else len(text)
            words = [x.start() for x in _WORD_RE.finditer(text, begin, end)]
            if end == len(text) or len(words) > 2 * overlap:
                break
            end += most
        if end == len(text):
            break
        yield text[begin:end]
        begin = words[-overlap]
    yield text[begin:] if begin else text


def shingles(h: np.ndarray) -> np.ndarray:
    """Shingle hashes of one word sequence, in order."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < SHINGLE:
        return np.array([word_sequence_hash(h)], np.uint64)
    return combine([h[j : len(h) - SHINGLE + 1 + j] for j in range(SHINGLE)])


def signs(h: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1: the bits of feature hashes."""
    bits = np.unpackbits(mix(h ^ np.uint64(0x51ED270B)).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
    bits += bits
    bits -= 1
    return bits


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from sums of signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)[:, 0]


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """The 16-bit blocks of fingerprints, one row each."""
    return prints.view(np.uint16).reshape(-1, BLOCKS).astype(np.int64)


class Items:
    """Fingerprints of benchmark items by window size, and the blocks' tables."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.by_size: list[dict] = []
        self.short: dict[int, dict[int, list[int]]] = {}
        w = Words([t for _, t in items], lower=True)
        known: set[int] = set()
        full = []
        for k, (item, _) in enumerate(items):
            h = w.hash[w.offset[k] : w.offset[k + 1]]
            if len(h) >= SHINGLE:
                s = shingles(h)
                known.update(s.tolist())
                full.append((len(h), item, Counter(s.tolist()), fingerprint(signs(s).sum(0, dtype=np.int32)[None])[0]))
            elif len(h):
                self.short.setdefault(len(h), {}).setdefault(int(word_sequence_hash(h)), []).append(item)
        full.sort(key=lambda x: (x[0], x[1]))
        #: Words around an item's place that a search for it may look at.
        self.reach = max(16, 2 * max([x[0] for x in full] + list(self.short), default=0))
        self.known = np.array(sorted(known), np.uint64)
        values = np.arange(1 << 16, dtype=np.uint16)
        while full:
            least = full[0][0]
            group = [x for x in full if x[0] <= least * SIZE_STEP][:64]
            full = full[len(group) :]
            prints = np.array([x[3] for x in group], np.uint64)
            near = np.zeros((BLOCKS, 1 << 16), np.uint64)
            for i, blocks in enumerate(blocks_of(prints)):
                for b in range(BLOCKS):
                    # Every block value within the errors that the pigeonhole principle allows has the item's bit.
                    close = np.bitwise_count(values ^ np.uint16(blocks[b])) <= RADIUS // BLOCKS
                    near[b] |= close.astype(np.uint64) << np.uint64(i)
            self.by_size.append({"size": (least + group[-1][0]) // 2, "items": [x[:3] for x in group], "prints": prints, "near": near})

    @staticmethod
    def _verify(h: np.ndarray, begin: int, n: int, weights: Counter, stride: int) -> bool:
        """Whether a window of the item's n words that begins near ``begin`` in a document's shingles h is similar enough."""
        m, total = n - SHINGLE + 1, sum(weights.values())
        for at in range(max(0, begin - stride), max(0, min(len(h) - 1, begin + stride)) + 1):
            got = Counter(h[at : at + m].tolist())
            both = sum(min(c, weights[s]) for s, c in got.items() if s in weights)
            if 100 * both >= PER_CENT * (total + sum(got.values()) - both):
                return True
        return False

    def hits(self, texts: list[bytes]) -> list[set[int]]:
        """For each text the items that it holds."""
        w = Words(texts, lower=True)
        out: list[set[int]] = [set() for _ in texts]
        counts = np.diff(w.offset)
        owner = np.repeat(np.arange(len(texts)), counts)
        for n, known in self.short.items():
            if len(w.hash) >= n:
                seq = combine([w.hash[j : len(w.hash) - n + 1 + j] for j in range(n)]) ^ np.uint64(0xA5A5A5A5A5A5A5A5 + n)
                for k in np.flatnonzero(np.isin(seq, np.array(list(known), np.uint64))):
                    if owner[k] == owner[k + n - 1]:
                        out[owner[k]].update(known[int(seq[k])])
        if len(w.hash) < SHINGLE or not self.by_size:
            return out
        h = shingles(w.hash)
        inside = owner[: len(h)] == owner[SHINGLE - 1 :]
        features = signs(h)
        features[~inside] = 0
        common = np.concatenate([[0], np.cumsum(np.isin(h, self.known) & inside)])
        running: dict[type, np.ndarray] = {}
        for g in self.by_size:
            m = g["size"] - SHINGLE + 1
            # Sums of a window fit their type although running sums wrap around.
            kind = np.int8 if m < 128 else np.int32
            if kind not in running:
                running[kind] = np.zeros((len(h) + 1, 64), kind)
                np.cumsum(features, axis=0, dtype=kind, out=running[kind][1:])
            sums = running[kind]
            stride = max(1, g["size"] // STRIDES)
            starts = np.arange(0, max(1, len(h) - m + stride), stride)
            prints = fingerprint(sums[np.minimum(starts + m, len(h))] - sums[starts])
            blocks = blocks_of(prints)
            some = g["near"][0].take(blocks[:, 0])
            for b in range(1, BLOCKS):
                some |= g["near"][b].take(blocks[:, b])
            for i, (n, item, weights) in enumerate(g["items"]):
                may = np.flatnonzero(some & np.uint64(1 << i))
                may = may[np.bitwise_count(prints[may] ^ g["prints"][i]) <= RADIUS]
                if not len(may):
                    continue
                # Items' shingles around the window bound its weight of shared ones from above.
                reach = max(n, g["size"]) + 2 * stride
                a, z = np.maximum(starts[may] - reach, 0), np.minimum(starts[may] + reach, len(h))
                for k in starts[may[100 * (common[z] - common[a]) >= PER_CENT * len(weights)]].tolist():
                    for text in range(owner[k], owner[min(k + m, len(owner) - 1)] + 1):
                        if counts[text] >= SHINGLE and item not in out[text]:
                            first = w.offset[text]
                            own = h[first : w.offset[text + 1] - SHINGLE + 1]
                            if self._verify(own, max(0, k - first), n, weights, 2 * stride):
                                out[text].add(item)
        return out


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "_items") -> DataFrame:
    """df with ``into``: the sorted ids of the benchmark items (item_id, text) that a document holds."""
    rest = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.ArrayType(T.LongType()))])
    found = benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null").distinct()
    passes = max(1, -(-found.count() // MAX_ITEMS))
    out = None
    for k in range(passes):
        mine = found if passes == 1 else found.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        items = sorted((r["item_id"], r["text"].encode()) for r in mine.toLocalIterator())
        sent = df.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, add=k > 0) -> Iterator[pa.RecordBatch]:
            index = Items(sent.value)
            for b in batches:
                texts = as_bytes(b.column(b.schema.get_field_index(text)))
                parts = [(k, p) for k, t in enumerate(texts) for p in pieces(t, PIECE_BYTES, index.reach)]
                bodies = [p for _, p in parts]
                hits = [set() for _ in texts]
                for i, j in chunks(bodies, PIECE_BYTES):
                    for (k, _), found_here in zip(parts[i:j], index.hits(bodies[i:j])):
                        hits[k] |= found_here
                if add:
                    hits = [h.union(old) for h, old in zip(hits, b.column(b.schema.get_field_index(into)).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array([sorted(h) for h in hits], pa.list_(pa.int64()))], names=schema.names)

        out = (df if out is None else out).mapInArrow(tidy(run), schema)
    return out


def op4_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("bigint").alias("n_items"), F.col("_items").alias("item_ids"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    safe, back = shield(docs)
    return back(contaminated(safe, table(spark, sf_dir, "benchmark")).where(F.size("_items") == 0))
