"""Exact substring dedup by prefix doubling over synchronising positions (operator 3).

Two bytes strings of LENGTH are equal only if their prefixes and parts are.  Ranks
of ever longer strings are compared, and a position leaves as soon as its rank is
unique; ranks are 64-bit names of strings instead of places in a global order, so
that a round is an aggregation and not a global sort.

Doubling over every byte would shuffle each byte's rank several times.  Instead a
string of LENGTH bytes is represented by its anchor, the position of its GRAM-byte
substring of least hash (leftmost at a tie): equal strings have their anchors at
equal places, and a run of starts shares one anchor.  The rounds are

1. GRAM bytes at each anchor: runs whose anchor is unique are done;
2. the whole stretch that a run's strings cover: equal stretches repeat each other
   entirely;
3. LENGTH bytes at each start of the stretches that are still undecided: those
   that share their anchor with different stretches.

A start is decided by names of 64 bits within one anchor of 64 bits.  Text meets
its spans by MD5; bitmaps of fixed size only spare rows that a later exact join
would drop.

Defined cases: a null text is empty; texts shorter than LENGTH keep everything; a
repeated row is another document; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import _M, _M_INV, _VALUES, CHUNK_BYTES, as_bytes, bitmap, chunks, discard, in_bitmap, mix, powers, settle, signed, sorted_groups, table, tidy

LENGTH, GRAM = 200, 32
_WINDOW = LENGTH - GRAM + 1
#: Stretches that a task remembers to have handed on.
REMEMBERED = 1 << 20
#: Different stretches of one anchor up to which one task compares them (some 100 MB of arrays); the strings of larger groups are dealt out one by one.
MAX_GROUP = 1 << 14


class Stretches:
    """Runs of starts that share an anchor, in the texts of a chunk.

    text: index of the text; start and end: first and last start, in the text;
    anchor: name of the GRAM bytes; stretch: name of all bytes and the anchor's place.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        n = len(raw) - LENGTH
        c = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[raw] * powers(_M, len(raw))[: len(raw)], out=c[1:])
        self._raw, inverse = raw, powers(_M_INV, len(raw) + 1)
        gram = mix((c[GRAM : n + GRAM] - c[:n]) * inverse[:n])
        # The hash above, the position below: the least is the leftmost of the least hash.
        low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        size = 1
        while size * 2 <= _WINDOW:
            low = np.minimum(low[:-size], low[size:]) if len(low) > size else low[:0]
            size *= 2
        if size < _WINDOW:
            rest = _WINDOW - size
            low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begins = ends - sizes
        count = np.maximum(sizes - LENGTH + 1, 0)
        full = np.flatnonzero(count)
        starts = np.repeat(begins[full] - np.concatenate([[0], np.cumsum(count[full])[:-1]]), count[full]) + np.arange(count[full].sum())
        owner = np.repeat(full, count[full])
        place = at[starts] if len(starts) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]) if len(starts) else np.zeros(0, np.int64)
        last = np.r_[first[1:] - 1, len(starts) - 1] if len(first) else first
        self._first, self._last, self._place = starts[first], starts[last], place[first]
        self.text = owner[first]
        self.start, self.end = self._first - begins[self.text], self._last - begins[self.text]
        self.anchor = gram[self._place] if len(first) else np.zeros(0, np.uint64)
        whole = (c[self._last + LENGTH] - c[self._first]) * inverse[self._first]
        self.stretch = mix(mix(whole) + ((self._place - self._first) << 32 | (self._last - self._first)).astype(np.uint64))

    def body(self, k: int) -> tuple[bytes, int]:
        """The bytes of a stretch, and its anchor's place in them."""
        return self._raw[self._first[k] : self._last[k] + LENGTH].tobytes(), int(self._place[k] - self._first[k])


def strings_of(bodies: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of some stretches: which one, the offset, and a name of its LENGTH bytes and its anchor's place."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * powers(_M, len(raw))[: len(raw)], out=c[1:])
    count = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(bodies)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[which] + offset
    name = (c[at + LENGTH] - c[at]) * powers(_M_INV, len(raw) + 1)[at]
    return which, offset, mix(mix(name) + (places[which] - offset).astype(np.uint64))


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """One row per document with its stretches; `_row` is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in chunks(texts):
                part = texts[i:j]
                s = Stretches(part)
                offsets = pa.array(np.searchsorted(s.text, np.arange(len(part) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (signed(s.anchor), signed(s.stretch), s.start.astype(np.int32), s.end.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.arange(row, row + len(part))), pa.array([hashlib.md5(t).digest() for t in part], pa.binary()), pa.array([len(t) for t in part], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in part]), *lists],
                    names=["doc_id", "_row", "_key", "n_bytes", "_whole", "anchor", "stretch", "first", "last"],
                )
                row += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(tidy(run), f"doc_id {kind}, _row bigint, _key binary, n_bytes bigint, _whole string, anchor array<bigint>, stretch array<bigint>, first array<int>, last array<int>")


def _undecided(docs: DataFrame, text: str, bits) -> DataFrame:
    """(anchor, stretch, place, body) for the stretches whose anchor is in the bitmap, mostly once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for b in batches:
            texts = as_bytes(b.column(0))
            for i, j in chunks(texts):
                s = Stretches(texts[i:j])
                pick = np.flatnonzero(in_bitmap(bits.value, s.anchor))
                new = []
                for k, key in zip(pick.tolist(), zip(s.anchor[pick].tolist(), s.stretch[pick].tolist())):
                    if key not in done:
                        done.add(key)
                        new.append(k)
                if len(done) > REMEMBERED:
                    done.clear()
                bodies = [s.body(k) for k in new]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.anchor[new])), pa.array(signed(s.stretch[new])), pa.array([p for _, p in bodies], pa.int32()), pa.array([t for t, _ in bodies], pa.binary())], names=["anchor", "stretch", "place", "body"])

    return docs.select(text).mapInArrow(tidy(run), "anchor bigint, stretch bigint, place int, body binary")


_RANGES = "anchor bigint, stretch bigint, first array<int>, last array<int>"


def _ranges(anchor: np.ndarray, stretch: np.ndarray, which: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """One row for each of the stretches ``which`` (in order) with the runs of its offsets."""
    begin = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(which) else np.zeros(0, np.int64)
    end = np.r_[begin[1:] - 1, len(which) - 1] if len(begin) else begin
    own, at = np.unique(which[begin], return_index=True)
    bounds = pa.array(np.r_[at, len(begin)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(offset[x].astype(np.int32))) for x in (begin, end)]
    return pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(stretch[own]), *lists], names=["anchor", "stretch", "first", "last"])


def _shared_in_groups(stretches: DataFrame) -> DataFrame:
    """(anchor, stretch, first, last) of single stretches: the runs of starts whose strings also occur in another stretch of the anchor; groups lie whole in one task."""

    def shared(anchor: np.ndarray, stretch: np.ndarray, places: np.ndarray, single: np.ndarray, bodies: list[bytes]) -> pa.RecordBatch:
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (stretch[1:] != stretch[:-1])]) if len(anchor) else np.zeros(0, np.int64)
        which, offset, name = strings_of([bodies[k] for k in new], places[new])
        _, at, count = np.unique(mix(name ^ mix(anchor[new].view(np.uint64)[which])), return_inverse=True, return_counts=True)
        twice = (count[at] > 1) & single[new][which]
        return _ranges(anchor[new], stretch[new], which[twice], offset[twice])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in sorted_groups(batches, 1):
            # Some groups at a time, about CHUNK_BYTES of them.
            ends = np.cumsum(np.r_[0, pc.binary_length(b.column(4)).to_numpy()])[at]
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK_BYTES, side="right")) - 1)
                part = b.slice(int(at[i]), int(at[j] - at[i]))
                yield shared(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_pylist())
                i = j

    dealt = stretches.repartition("anchor").sortWithinPartitions("anchor", "stretch")
    return dealt.select("anchor", "stretch", "place", "single", "body").mapInArrow(tidy(run), _RANGES)


def _shared_by_string(stretches: DataFrame) -> DataFrame:
    """The same for the largest groups: one row a start, dealt out by its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column(4).to_pylist()
            for i, j in chunks(bodies, 1 << 18):
                which, offset, name = strings_of(bodies[i:j], b.column(2).to_numpy()[i:j].astype(np.int64))
                anchor, stretch, single = b.column(0).to_numpy()[i:j], b.column(1).to_numpy()[i:j], b.column(3).to_numpy(zero_copy_only=False)[i:j]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[which]), pa.array(stretch[which]), pa.array(single[which]), pa.array(offset.astype(np.int32)), pa.array(signed(name))], names=["anchor", "stretch", "single", "first", "name"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = b.column(2)
            yield _ranges(b.column(0).to_numpy(), b.column(1).to_numpy(), np.repeat(np.arange(b.num_rows), pc.list_value_length(starts).to_numpy()), starts.flatten().to_numpy())

    strings = stretches.select("anchor", "stretch", "place", "single", "body").mapInArrow(run, "anchor bigint, stretch bigint, single boolean, first int, name bigint")
    strings = settle(strings, "repeats-strings")
    twice = settle(strings.groupBy("anchor", "name").agg(F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("low <> high").select("anchor", "name"), "repeats-twice")
    starts = strings.where("single").join(twice, ["anchor", "name"]).groupBy("anchor", "stretch").agg(F.sort_array(F.collect_set("first")).alias("first"))
    return starts.mapInArrow(merge, _RANGES)


def repeated_starts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Settled documents (doc_id, _row, _key, n_bytes, _whole, ..) and (_row, first, last): the starts whose LENGTH bytes also start elsewhere."""
    spark = docs.sparkSession
    rows = settle(_documents(docs, text), "repeats-documents")
    runs = rows.select("_row", F.expr("inline(arrays_zip(anchor, stretch, first, last))"))
    # Round 1: anchors that occur again.  They are settled, so that a join can split the rows of a frequent one.
    again = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high")).where("n > 1")
    again = settle(again.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "repeats-again")
    met = settle(runs.join(again, "anchor"), "repeats-met")
    # Round 2: stretches that occur again.
    mixed = met.where("mixed")
    sizes = settle(mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("n")), "repeats-sizes")
    whole = met.where("not mixed").select("_row", "first", "last").unionByName(mixed.join(sizes.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select("_row", "first", "last"))
    # Round 3: strings of the single stretches, which differ from others although their anchors are equal.
    groups = sizes.groupBy("anchor").agg(F.count("*").alias("stretches"), F.sum("n").alias("copies"), F.min("n").alias("least")).where("least = 1")
    groups = settle(groups.select("anchor", (F.col("stretches") > MAX_GROUP).alias("large"), ((F.col("copies") > MAX_GROUP) & (F.col("stretches") <= MAX_GROUP)).alias("copied")), "repeats-groups")
    bits = spark.sparkContext.broadcast(bitmap(groups, "anchor"))
    known = sizes.join(groups, "anchor").select("anchor", "stretch", (F.col("n") == 1).alias("single"), "large", "copied")
    open_ = settle(_undecided(docs, text, bits).join(known, ["anchor", "stretch"]), "repeats-stretches")
    # Each task hands a stretch on about once; of one with many copies one is enough.
    hits = _shared_in_groups(open_.where("not copied and not large").unionByName(open_.where("copied").dropDuplicates(["anchor", "stretch"])))
    if groups.where("large").limit(1).count():
        hits = hits.unionByName(_shared_by_string(open_.where("large").dropDuplicates(["anchor", "stretch"])))
    edges = mixed.select("_row", "anchor", "stretch", F.col("first").alias("start")).join(hits, ["anchor", "stretch"])
    edges = edges.select("_row", "start", F.expr("inline(arrays_zip(first, last))")).select("_row", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    out = settle(whole.unionByName(edges), "repeats-starts")
    discard(again, met, sizes, groups, open_)
    return rows, out


def kept_bytes(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and maximal runs removed."""
    if not len(first):
        return text, 0, 0
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order] + LENGTH)
    new = np.r_[True, first[1:] > reach[:-1]]
    a, z = first[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]]
    left = b"".join(text[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), len(text)]))
    return left, int((z - a).sum()), len(a)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text): every document without its repeated bytes; kept_text is binary, null where nothing is removed."""
    spark = docs.sparkSession
    rows, starts = repeated_starts(docs, text)
    per_row = starts.groupBy("_row").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    # Copies of a text have the same starts: one of them stands for all.
    per_text = settle(rows.select("_row", "_key").join(per_row, "_row").groupBy("_key").agg(F.min_by("starts", "_row").alias("starts")), "repeats-spans")
    mark = F.expr("conv(substr(hex(_key), 1, 15), 16, 10)").cast("bigint")
    bits = spark.sparkContext.broadcast(bitmap(per_text.select(mark.alias("k")), "k"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits.value, b.column(2).to_numpy())))

    # Texts that lose something: one row a text, for copies need it once.
    keyed = docs.select(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("h"), F.col(text).alias("t"))
    keyed = keyed.select(F.unhex("h").alias("_key"), "t").withColumn("k", mark)
    texts = keyed.mapInArrow(tidy(some), "_key binary, t string, k bigint").drop("k").dropDuplicates(["_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, gone, spans = [], [], []
            starts = b.column(2)
            for k, t in enumerate(as_bytes(b.column(1))):
                s = starts.slice(k, 1).flatten()
                left, n, m = kept_bytes(t, s.field("first").to_numpy(), s.field("last").to_numpy())
                out.append(left)
                gone.append(n)
                spans.append(m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, pa.binary())], names=["_key", "n_removed", "n_spans", "kept_text"])

    done = texts.join(per_text, "_key").mapInArrow(tidy(cut), "_key binary, n_removed bigint, n_spans bigint, kept_text binary")
    return rows.select("doc_id", "_key", "n_bytes", "_whole").join(done, "_key", "left")


def op3_suffix_array_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    zero = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce(F.sha2("kept_text", 256), "_whole").alias("kept_sha256"))
