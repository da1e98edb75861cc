"""Near-duplicates by a multi-index Hamming join of MinHash signatures (operator 6).

A document's set is that of its distinct five-word shingles (A-Z lower-cased; with
fewer words the whole sequence).  Documents of equal sets form a class.  Each class
has a signature of ``SIGNATURE`` minima of 16 bits, cut into chunks of ``CHUNK``
values.  By the pigeonhole principle two signatures that differ in ``RADIUS`` values
at most have a chunk with at most one difference; a class is entered under each of
a chunk's ways to leave one value out, so every such pair meets under a key.  At
the threshold the chance that a pair shares no key is below 1 in 30,000.  Links are
confirmed on full sets (100 * intersection >= 75 * union).

A key's classes are not paired with one another.  Each is tried against the class
that leads most of its keys; then, for some rounds, each class of a key that still
has several components is tried against the one nearest by signature in another
component, found in blocks of bounded size.  ``SIEVE`` minima beside the signature
only spare these trials pairs that are far beyond the threshold.  Confirmed links
join components.  What is then still open is searched without loss.  Keys of up to
``CROWD`` classes give every pair of different components that the sieve leaves.
In larger keys two sets that are similar enough share one of their rarest shingles
(a prefix filter with sizes and places): their classes are dealt out by those, and
every pair of different components that these bounds leave is confirmed.  No
partner is dropped.

Defined cases: a text without words has an empty set, links with nothing and is
kept; a text may be of any length (its set takes 8 bytes a shingle); equally near
partners are tried in the order of their sets' names; repeated rows are copies of
each other and each returns; rows of a null doc_id belong to no component and are
kept; other columns pass through the stage whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import Words, alike, as_bytes, bitmap, chunks, discard, in_bitmap, mix, settle, settle_by, shield, signed, sorted_groups, table, tidy, without, word_sequence_hash
from glyphlake.llm.graph import components

SHINGLE, PER_CENT = 5, 75
#: Minima of a signature, how many make a chunk, and the distance up to which every pair meets.
SIGNATURE, CHUNK = 32, 4
RADIUS = 2 * (SIGNATURE // CHUNK) - 1
#: Further minima of the sieve; and the number of differing minima, of both together, beyond which a pair is not tried: over five standard deviations above the mean at the threshold.
SIEVE, MAX_DISTANCE = 96, 58
VALUES = SIGNATURE + SIEVE
#: Rounds in which classes are tried against the nearest one of another component.
ROUNDS = 4
#: Classes of a block in the comparison of large keys; classes up to which a key's pairs are all compared in the end.
BLOCK, CROWD = 1024, 128
#: Shingles that the order of prefixes knows to be frequent, and what the sketch that finds them tracks.
FREQUENT, TRACKED = 100_000, 1 << 18
_RNG = np.random.default_rng(6)
_MULTIPLY = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64)
_ALIKE_IN_SIZE = f"100 * least(m, n) >= {PER_CENT} * greatest(m, n)"
_SUM_2 = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h, offset = w.windows(SHINGLE)
    out = []
    for i in range(len(texts)):
        if offset[i + 1] > offset[i]:
            out.append(np.unique(h[offset[i] : offset[i + 1]]))
        else:
            words = w.hash[w.offset[i] : w.offset[i + 1]]
            out.append(np.array([word_sequence_hash(words)], np.uint64) if len(words) else np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return np.array([s.sum() + np.uint64(len(s)), mix(s ^ _SUM_2).sum()], np.uint64).tobytes() if len(s) else b""


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The 16-bit minima of each non-empty set: SIGNATURE of the signature, then those of the sieve."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), VALUES), np.uint16)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat((flat ^ _ADD[k]) * _MULTIPLY[k], starts) >> np.uint64(32)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: for every chunk, its values but one, for each one, with their place above them."""
    v = sig.astype(np.uint64)
    out = []
    for c in range(0, SIGNATURE, CHUNK):
        for left_out in range(CHUNK):
            h = np.full(len(v), c + left_out, np.uint64)
            for k in range(CHUNK):
                if k != left_out:
                    h = h << np.uint64(16) | v[:, c + k]
            out.append(h)
    return np.stack(out, 1)


def _prepared(docs: DataFrame, text: str) -> DataFrame:
    """One row per document: doc_id, its set's size and key, its minima and index keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            n, key, sig, keys = [], [], [], []
            for i, j in chunks(texts):
                sets = shingle_sets(texts[i:j])
                n += [len(s) for s in sets]
                key += [set_key(s) for s in sets]
                full = [k for k, s in enumerate(sets) if len(s)]
                sigs: list = [None] * len(sets)
                many: list = [None] * len(sets)
                if full:
                    m = signatures([sets[k] for k in full])
                    for k, row, index in zip(full, m, signed(index_keys(m))):
                        sigs[k], many[k] = row.tobytes(), index
                sig += sigs
                keys += many
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "set", "sig", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(tidy(run), f"doc_id {kind}, n bigint, set binary, sig binary, keys array<bigint>")


def _sets_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(set, items): the sorted hashes of the wanted classes (doc_id, set), each from the text of its least document.

    A bitmap of fixed size spares the texts that the join would drop.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("doc_id").alias("k")), "k"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_bitmap(bits.value, b.column(2).to_numpy())))
            texts = as_bytes(b.column(1))
            for i, j in chunks(texts):
                sets = shingle_sets(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set", "items"])

    found = docs.where("doc_id is not null").select("doc_id", text, F.xxhash64("doc_id").alias("k")).mapInArrow(tidy(run), f"doc_id {kind}, set binary, items binary")
    # Joined by set alone, for that is how the sets are kept.
    same = ~((F.col("doc_id") < F.col("least")) | (F.col("doc_id") > F.col("least")))
    return found.join(alike(wanted.select("set", F.col("doc_id").alias("least"))), "set").where(same).select("set", "items").dropDuplicates(["set"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if 100 * small < PER_CENT * large:
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PER_CENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    left, right = sets.select(F.col("set").alias("a"), F.col("items").alias("x")), sets.select(F.col("set").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(alike(left), "a").join(alike(right), "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _by_signature(pairs: DataFrame) -> DataFrame:
    """The rows of pairs (.., x, y) whose minima x and y differ in MAX_DISTANCE places at most."""
    schema = pairs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(-1, VALUES) for c in "xy")
            yield b.filter(pa.array((x != y).sum(1) <= MAX_DISTANCE))

    return pairs.mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, group: str, size: str, columns: list[str]) -> DataFrame:
    """Rows (group, low, high, own, ..) sorted by group, low and high: each pair of blocks of a group together in one task."""
    blocks = F.ceil(F.col(size) / BLOCK)
    own = F.pmod(F.xxhash64("set"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select(F.col(group).alias("group"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *columns)
    return dealt.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "set").select("group", "low", "high", "own", *columns)


def _near(rows: DataFrame, every: bool = False) -> DataFrame:
    """(set, partner, distance) of classes of rows (key, set, label, sig, n, size) that share a key but no label and are alike in size: the nearest of each in each block, or every one that the sieve leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in sorted_groups(batches, 3):
            low, high, own, label = (b.column(k).to_numpy() for k in (1, 2, 3, 5))
            sig = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint16).reshape(-1, VALUES)
            n = b.column(7).to_numpy()
            who, partner, away = [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if j - i < 2 or (label[i:j] == label[i]).all():
                    continue
                if low[i] == high[i]:
                    left = right = np.arange(i, j)
                else:
                    left, right = i + np.flatnonzero(own[i:j] == low[i]), i + np.flatnonzero(own[i:j] == high[i])
                    if not len(left) or not len(right):
                        continue
                far = np.empty((len(left), len(right)), np.int16)
                for k, row in enumerate(left):
                    never = (label[right] == label[row]) | (100 * np.minimum(n[right], n[row]) < PER_CENT * np.maximum(n[right], n[row]))
                    far[k] = np.where(never, VALUES + 1, (sig[right] != sig[row]).sum(1))
                if every:
                    x, y = np.nonzero(far <= MAX_DISTANCE)
                    x, y = (x[x < y], y[x < y]) if left is right else (x, y)
                    who.append(left[x])
                    partner.append(right[y])
                    away.append(far[x, y])
                    continue
                for mine, theirs, best in ((left, right, far.argmin(1)), (right, left, far.argmin(0))):
                    least = far[np.arange(len(left)), best] if mine is left else far[best, np.arange(len(right))]
                    ok = least <= MAX_DISTANCE
                    who.append(mine[ok])
                    partner.append(theirs[best[ok]])
                    away.append(least[ok])
                    if left is right:
                        break
            if who:
                yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(np.concatenate(x))) for x in (who, partner)] + [pa.array(np.concatenate(away).astype(np.int32))], names=["set", "partner", "distance"])

    return _in_blocks(rows, "key", "size", ["set", "label", "sig", "n"]).mapInArrow(tidy(run), "set binary, partner binary, distance int")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of some sets, sorted, and their counts, by a mergeable sketch: FREQUENT of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], names=["s"])

    top = sets.select("items").mapInArrow(run, "s bigint").agg(F.expr(f"approx_top_k(s, {FREQUENT}, {TRACKED})").alias("x")).select(F.inline("x")).toArrow()
    key, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def prefix(items: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest shingles of a set, in one order for all sets: a similar set has one of them among its own."""
    key, n = frequent
    times = np.zeros(len(items), np.int64)
    if len(key):
        at = np.minimum(np.searchsorted(key, items), len(key) - 1)
        times = np.where(key[at] == items, n[at], 0)
    return items[np.lexsort((items, times))[: len(items) - (PER_CENT * len(items) + 99) // 100 + 1]]


def may_reach(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one stands at ``place`` and ``other`` can be similar enough."""
    least = PER_CENT * (n + m)
    return ((100 + PER_CENT) * np.minimum(n - place, m - other) >= least) & (100 * np.minimum(n, m) >= PER_CENT * np.maximum(n, m))


def _prefix_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Every pair (a, b) of classes (set, label) of different labels that the prefix filter leaves."""
    mine = sets.join(open_, "set")
    sent = open_.sparkSession.sparkContext.broadcast(_frequent(mine))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            first = [prefix(s, sent.value) for s in sets]
            if not first:
                continue
            sizes = np.array([len(x) for x in first])
            at = np.repeat(np.arange(len(first)), sizes)
            place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(first))), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.array([len(s) for s in sets], np.int32)[at]), pa.array(place.astype(np.int32))], names=["shingle", "set", "label", "n", "place"])

    rows = settle(mine.select("set", "label", "items").mapInArrow(entries, "shingle bigint, set binary, label bigint, n int, place int"), "near-prefixes")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("size"), F.min("label").alias("low_label"), F.max("label").alias("high_label")).where("low_label <> high_label")
    dealt = _in_blocks(rows.join(shared.select("shingle", "size"), "shingle"), "shingle", "size", ["set", "label", "n", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in sorted_groups(batches, 3):
            low, high, own, label, n, place = (b.column(k).to_numpy() for k in (1, 2, 3, 5, 6, 7))
            left, right = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                if j - i < 2 or (label[i:j] == label[i]).all():
                    continue
                if low[i] == high[i]:
                    for k in range(i, j - 1):
                        may = np.flatnonzero((label[k + 1 : j] != label[k]) & may_reach(n[k], place[k], n[k + 1 : j], place[k + 1 : j])) + k + 1
                        left.append(np.full(len(may), k))
                        right.append(may)
                else:
                    others = i + np.flatnonzero(own[i:j] == high[i])
                    for k in (i + np.flatnonzero(own[i:j] == low[i])).tolist():
                        may = others[(label[others] != label[k]) & may_reach(n[k], place[k], n[others], place[others])]
                        left.append(np.full(len(may), k))
                        right.append(may)
            if left:
                yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(np.concatenate(x))) for x in (left, right)], names=["x", "y"])

    return dealt.mapInArrow(run, "x binary, y binary").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes_and_links(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled rows (doc_id, n, set), classes (set, doc_id, label) and confirmed links (a, b) that join every component."""
    prepared = settle(_prepared(docs, text), "near-prepared")
    rows = prepared.select("doc_id", "n", "set")
    classes = settle_by(prepared.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "near-classes", "set")
    entries = classes.select("set", F.explode("keys").alias("key"))
    shared = settle(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-shared")
    members = settle(entries.join(alike(shared), "key"), "near-members")
    discard(shared)
    sig = classes.select("set", "sig", "n")
    sets = settle_by(_sets_of(docs, text, members.select("set").distinct().join(alike(classes.select("set", "doc_id")), "set")), "near-sets", "set")

    def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """Labels of all classes once further links are known."""
        if labels is None:
            labels = classes.select("set", F.col("set").alias("label"))
        ends = links.join(labels.select(F.col("set").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("set").alias("b"), F.col("label").alias("y")), "b")
        got = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), "near-round")
        out = settle(labels.join(got.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("set", F.coalesce("to", "label").alias("label")), "near-labels")
        discard(got)
        return out

    def open_rows(labels: DataFrame) -> DataFrame:
        """Members, with numbers for labels, of the keys that hold several components."""
        labelled = members.select("key", "set", "size").join(labels.select("set", F.xxhash64("label").alias("label")), "set")
        still = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        return labelled.join(still, "key")

    # First every class is tried against the one that leads most of its keys.
    leads = members.join(members.groupBy("key").agg(F.min("set").alias("lead")), "key").where("set <> lead")
    leads = leads.groupBy("set", "lead").agg(F.count("*").alias("n")).groupBy("set").agg(F.max(F.struct("n", "lead")).alias("m"))
    leads = leads.select(F.least("set", "m.lead").alias("a"), F.greatest("set", "m.lead").alias("b")).distinct()
    leads = leads.join(alike(sig.select(F.col("set").alias("a"), F.col("sig").alias("x"), F.col("n").alias("m"))), "a").join(alike(sig.select(F.col("set").alias("b"), F.col("sig").alias("y"), "n")), "b").where(_ALIKE_IN_SIZE)
    now = settle(_by_signature(leads.select("a", "b", "x", "y")).select("a", "b"), "near-now")
    links = settle(_confirm(now, sets), "near-links")
    labels, tried = joined(None, links), now
    # Then against the nearest one of another component, as long as that finds links.
    open_ = settle(open_rows(labels), "near-open")
    for _ in range(ROUNDS):
        found = _near(open_.join(alike(sig), "set").select("key", "set", "label", "sig", "n", "size"))
        found = found.groupBy("set").agg(F.min(F.struct("distance", "partner")).alias("m")).select(F.least("set", "m.partner").alias("a"), F.greatest("set", "m.partner").alias("b")).distinct()
        now = settle(found.join(tried, ["a", "b"], "left_anti"), "near-now")
        more = settle(_confirm(now, sets), "near-links")
        tried = tried.unionByName(now)
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
        old, was_open = labels, open_
        labels = joined(old, more)
        open_ = settle(open_rows(labels), "near-open")
        discard(old, was_open)
    # What is open still: every pair that the sieve or, in large keys, the prefix filter leaves.
    rest = _near(open_.where(F.col("size") <= CROWD).join(alike(sig), "set").select("key", "set", "label", "sig", "n", "size"), every=True)
    rest = rest.select(F.least("set", "partner").alias("a"), F.greatest("set", "partner").alias("b"))
    rest = rest.unionByName(_prefix_pairs(open_.where(F.col("size") > CROWD).select("set", "label").distinct(), sets))
    rest = settle(rest.distinct().join(tried, ["a", "b"], "left_anti"), "near-rest")
    more = settle(_confirm(rest, sets), "near-links")
    if more.limit(1).count():
        links = links.unionByName(more)
        old = labels
        labels = joined(old, more)
        discard(old)
    discard(members, open_, rest, sets)
    return rows, classes.select("set", "doc_id").join(labels, "set"), links


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    rows, classes, _ = classes_and_links(docs, text)
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = classes.select("set", "label").join(least, "label").select("set", "component_id")
    out = rows.join(named, "set", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least doc_id, once if its row is repeated."""
    safe, back = shield(docs)
    found = settle(near_duplicates(safe.select("doc_id", "text")), "near-found")
    copies = found.where("not kept").select("doc_id").distinct()
    kept = without(safe, copies, "doc_id")
    again = found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.limit(1).count():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id").dropDuplicates(["doc_id", "text"]).select(*safe.columns))
    return back(kept)
