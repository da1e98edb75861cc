"""Language-model scoring by logistic context mixing over bits (operator 10).

Every byte of a text, and one zero byte that ends it, is predicted bit by bit.
Predictors of orders 1 to 5 (the bytes before, and the bits of this byte so far)
hold counts of zeros and ones; a gated set of weights mixes their log odds, and a
table indexed by the previous byte and the mixed odds refines the result.  Counts
are exact and come from the whole training text: each task counts its windows of
six bytes and Spark adds them up.  Windows are dealt into shards by the three
bytes before the last, so that all counts of orders 3 to 5 meet in one task; those
of orders 1 and 2 (at most 2^24 strings of three bytes) go to every task.
Weights and table are learned online in every shard, one mini-batch after another,
on all its training windows by their counts, less the window's own occurrence, and
averaged over the shards by what each gate and cell has seen.
A first pass learns and a second gives every distinct window its log
probability, also windows that only scored texts hold (their count is zero).
Scoring uses the model as learned, so a text's score doesn't depend on other
scored texts.  The ``HEAD_WINDOWS`` most frequent windows go to every task; the
others meet the texts in a join, like rare tokens.

The base score is that of the contract: add-one unigrams.  Counts of the
``HEAD_TOKENS`` most frequent tokens go to every task (bounded); the others meet
the texts in a join by token.

Defined cases: a null or empty text has the end token alone; a text may be of any
length (its windows take 8 bytes a byte, its rare ones 12 each in its row); windows
and tokens of equal counts are sent to every task all or none; repeated rows count
and return once each; without training rows every count is zero; a null doc_id is
held out; lm_scores() returns the columns asked for beside its own, which start
with an underscore; an empty table gives an empty one.  Tokens are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from glyphlake.llm.common import Words, as_bytes, chunks, settle, signed, table, tidy

#: Tokens whose counts are sent to every task (16 bytes each).
HEAD_TOKENS = 1 << 18
#: Windows whose log probabilities are sent to every task (12 bytes each).
HEAD_WINDOWS = 1 << 23
#: Distinct training windows of a shard, about; their number grows with the input.
SHARD = 1 << 18
#: Orders whose counts go to every task.
LOW_ORDERS = 2
#: Log2 of the slots of orders 1 to 5 in a small model held in one table (Model).
SLOT_BITS = (16, 19, 21, 21, 22)
#: Bytes of a window: the context of the highest order and the byte itself.
WIDTH = len(SLOT_BITS) + 1
#: Rows of one online step.
STEP = 1 << 10
#: Distinct windows that a task gathers before it hands on their counts.
MAX_DISTINCT = 1 << 20
_STARTS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])]).astype(np.int64)
_MEMO_BITS = 20
_LEARNED = "weights binary, mass binary, cells binary, seen binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GRAM, _TOKEN = 0, 1
_CLIP, _CELLS, BIAS = 12.0, 24, 0.3


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and the end of each text the WIDTH bytes that end there, as one integer; and each text's span of them."""
    before = bytes(WIDTH - 1)
    raw = np.frombuffer(b"".join(before + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    sizes = np.fromiter((len(t) + WIDTH for t in texts), np.int64, len(texts))
    w = raw.copy()
    for k in range(1, WIDTH):
        w[k:] |= raw[:-k] << (8 * k)
    ends = np.cumsum(sizes)
    real = np.ones(len(raw), bool)
    for k in range(WIDTH - 1):
        real[ends - sizes + k] = False
    return w[real], np.concatenate([[0], np.cumsum(sizes - WIDTH + 1)])


def slots(w: np.ndarray, bit: int) -> list[np.ndarray]:
    """Slot of each order for one bit (7 the first) of the last byte of some windows."""
    node = (1 << (7 - bit)) | ((w & 255) >> (bit + 1))
    out = []
    for order, bits in enumerate(SLOT_BITS, 1):
        context = (w >> 8) & ((1 << (8 * order)) - 1)
        key = context.view(np.uint64) * np.uint64(0xD6E8FEB86659FD95) + node.view(np.uint64) + np.uint64(order << 56)
        key = (key ^ (key >> np.uint64(31))) * _MIX
        key = (key ^ (key >> np.uint64(29))) * _MIX
        out.append((key >> np.uint64(64 - bits)).astype(np.int64) + _STARTS[order - 1])
    return out


def _training(doc_id: pa.Array, held: pa.Array) -> np.ndarray:
    return ~np.array([x is None or x for x in held.to_pylist()], bool)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over rows (text, held_out): windows and tokens of training texts; key 0 of kind 2 counts the texts."""

    def flush(kind: int, parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            key, n = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n)], names=["kind", "key", "n"])
            parts.clear()

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return key[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {_GRAM: [], _TOKEN: []}
        n_texts = 0
        for b in batches:
            train = _training(None, b.column(1))
            all_texts = as_bytes(b.column(0))
            texts = [t for t, x in zip(all_texts, train) if x]
            n_texts += len(texts)
            # Windows of held-out texts are scored too; they count nothing.
            others = [t for t, x in zip(all_texts, train) if not x]
            for i, j in chunks(others):
                u = np.unique(windows_of(others[i:j])[0])
                kept[_GRAM].append((u, np.zeros(len(u), np.int64)))
            for i, j in chunks(texts):
                for kind, keys in ((_GRAM, windows_of(texts[i:j])[0]), (_TOKEN, signed(Words(texts[i:j], lower=True).hash))):
                    parts = kept[kind]
                    parts.append(np.unique(keys, return_counts=True))
                    if sum(len(p[0]) for p in parts) > MAX_DISTINCT:
                        parts[:] = [merge(parts)]
                        if len(parts[0][0]) > MAX_DISTINCT // 2:
                            yield from flush(kind, parts)
        for kind, parts in kept.items():
            yield from flush(kind, parts)
        if n_texts:
            yield from flush(2, [(np.zeros(1, np.int64), np.array([n_texts], np.int64))])

    return docs.select("text", "held_out").mapInArrow(tidy(run), "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def node(w: np.ndarray, order: int, bit: int) -> np.ndarray:
    """The context of an order and the bits of the last byte before ``bit``, as one integer."""
    return (w >> (bit + 1)) & ((1 << (8 * order + 7 - bit)) - 1)


def tally(w: np.ndarray, n: np.ndarray, order: int, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of windows w that occur n times, their zeros and ones, and each window's place among them."""
    u, at = np.unique(node(w, order, bit), return_inverse=True)
    whole = np.bincount(at, n, len(u))
    ones = np.bincount(at, n * (w >> bit & 1), len(u))
    return u, whole - ones, ones, at


def low_counts(grams: DataFrame) -> list[list[tuple[np.ndarray, ...]]]:
    """(nodes, zeros, ones) of the low orders, by order and bit; at most 2^24 rows are collected."""
    mask = (1 << (8 * (LOW_ORDERS + 1))) - 1
    got = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(mask)).cast("int").alias("key")).agg(F.sum("n").alias("n")).toArrow()
    w, n = got.column("key").to_numpy().astype(np.int64), got.column("n").to_numpy()
    return [[tally(w, n, order, bit)[:3] for bit in range(8)] for order in range(1, LOW_ORDERS + 1)]


def counts_of(w: np.ndarray, n: np.ndarray, low: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """By bit the zeros and ones, a column an order, that a whole shard's windows meet."""
    out = []
    for bit in range(8):
        zeros, ones = np.zeros((len(w), len(SLOT_BITS)), np.float32), np.zeros((len(w), len(SLOT_BITS)), np.float32)
        for order in range(1, len(SLOT_BITS) + 1):
            if order > LOW_ORDERS:
                _, z, o, at = tally(w, n, order, bit)
            else:
                u, z, o = low[order - 1][bit]
                if not len(u):
                    continue
                key = node(w, order, bit)
                at = np.minimum(np.searchsorted(u, key), len(u) - 1)
                met = u[at] == key
                zeros[:, order - 1], ones[:, order - 1] = np.where(met, z[at], 0), np.where(met, o[at], 0)
                continue
            zeros[:, order - 1], ones[:, order - 1] = z[at], o[at]
        out.append((zeros, ones))
    return out


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + 0.2) / (zeros + 0.2)), -_CLIP, _CLIP)


class Model:
    """Log odds of every slot, gated weights and the refining table."""

    def __init__(self, odds: np.ndarray, weights: np.ndarray, table: np.ndarray):
        self.odds, self.weights, self.table = odds, weights, table
        self.memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.memo = np.zeros(1 << _MEMO_BITS)

    @staticmethod
    def gate(w: np.ndarray, bit: int, known: np.ndarray) -> np.ndarray:
        """Weights are chosen by the bit, the kind of the previous byte and how many orders have met their context."""
        return ((7 - bit) * 16 + ((w >> 8) & 255) // 16) * WIDTH + known

    @staticmethod
    def cell(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip((x + _CLIP) * (_CELLS / (2 * _CLIP)), 0, _CELLS - 1e-6)
        low = at.astype(np.int64)
        return ((w >> 8) & 255) * (_CELLS + 1) + low, at - low

    def log10(self, w: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each window given the others."""
        total = np.zeros(len(w))
        for bit in range(8):
            total += bit_log(w, bit, [self.odds.take(s) for s in slots(w, bit)], self.weights, self.table)
        return total / np.log(10)

    def score(self, w: np.ndarray) -> np.ndarray:
        """log10() through a memo of what this worker has met."""
        slot = ((w.view(np.uint64) * _MIX) >> np.uint64(64 - _MEMO_BITS)).view(np.int64)
        out = self.memo.take(slot)
        miss = np.flatnonzero(self.memo_key.take(slot) != w)
        if len(miss):
            u = np.unique(w[miss])
            p = self.log10(u)
            out[miss] = p[np.searchsorted(u, w[miss])]
            at = ((u.view(np.uint64) * _MIX) >> np.uint64(64 - _MEMO_BITS)).view(np.int64)
            self.memo_key[at] = u
            # Where two windows share a place the last written stays; its value must be its own.
            self.memo[at] = p
        return out


def bit_log(w: np.ndarray, bit: int, odds: list[np.ndarray], weights: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Natural log of the probability of one bit of each window, from its log odds by order."""
    # Counts that aren't even give odds, and those that are tell nothing either.
    own = weights[Model.gate(w, bit, sum((o != 0).astype(np.int64) for o in odds))]
    x = own[:, -1] * BIAS
    for k, o in enumerate(odds):
        x = x + own[:, k] * o
    x = np.clip(x, -_CLIP, _CLIP)
    cell, part = Model.cell(w, x)
    x = (x + table_[cell] * (1 - part) + table_[cell + 1] * part) / 2
    return -np.logaddexp(0, np.where(w >> bit & 1, -x, x))


def untrained() -> tuple[np.ndarray, np.ndarray]:
    weights = np.tile(np.array([0.3] * len(SLOT_BITS) + [0.0]), (128 * WIDTH, 1))
    return weights, np.tile(np.arange(_CELLS + 1) / (_CELLS / (2 * _CLIP)) - _CLIP, (256, 1)).ravel()


def learn(counted, w: np.ndarray, times: np.ndarray, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights, what each gate has seen, refining table and what each cell has seen, learned online.

    ``counted(begin, end, bit)`` gives zeros and ones of windows, a column an order;
    a window weighs as much as ``times`` occurrences.
    """
    weights, table_ = untrained()
    mass, seen = np.zeros(len(weights)), np.ones(len(table_))
    squares = np.full_like(weights, 1e-2)
    for begin in range(0, len(w), STEP):
        ww, n = w[begin : begin + STEP], times[begin : begin + STEP].astype(float)
        for bit in range(8):
            y = (ww >> bit & 1).astype(float)
            zeros, ones = counted(begin, begin + len(ww), bit)
            x = np.empty((len(ww), WIDTH))
            # One occurrence of the window itself is left out.
            x[:, :-1] = log_odds(np.maximum(zeros - (y == 0)[:, None], 0), np.maximum(ones - (y == 1)[:, None], 0))
            x[:, -1] = BIAS
            g = Model.gate(ww, bit, (x[:, :-1] != 0).sum(1))
            mixed = np.clip((weights[g] * x).sum(1), -_CLIP, _CLIP)
            error = (y - 1 / (1 + np.exp(-mixed))) * n
            step = np.stack([np.bincount(g, error * x[:, k], len(weights)) for k in range(WIDTH)], 1)
            mass += np.bincount(g, n, len(weights))
            squares += step * step
            weights += rate * step / np.sqrt(squares)
            cell, part = Model.cell(ww, mixed)
            for at, amount in ((cell, (1 - part) * n), (cell + 1, part * n)):
                p = 1 / (1 + np.exp(-table_[at]))
                push = np.bincount(at, amount * (y - p), len(table_))
                seen += np.bincount(at, amount, len(table_))
                table_ += 4 * push / (seen + 20)
    return weights, mass, np.clip(table_, -_CLIP, _CLIP), seen - 1


def learn_mixing(zeros: np.ndarray, ones: np.ndarray, w: np.ndarray, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refining table of a Model, learned online over windows w, each drawn as often as it is frequent."""

    def counted(begin: int, end: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.stack(slots(w[begin:end], bit), 1)
        return zeros[at], ones[at]

    weights, _, table_, _ = learn(counted, w, np.ones(len(w)), rate)
    return weights.astype(np.float32), table_.astype(np.float32)


def merged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Shards' weights and tables averaged, each gate and cell by what it has seen; the unseen stay as they began."""
    out = []
    for start, value, seen in zip(untrained(), ("weights", "cells"), ("mass", "seen")):
        sums, whole = np.zeros_like(start), np.zeros(len(start))
        for r in rows:
            n = np.frombuffer(r[seen])
            v = np.frombuffer(r[value]).reshape(start.shape)
            sums += v * (n[:, None] if start.ndim > 1 else n)
            whole += n
        by = np.maximum(whole, 1e-300)
        out.append(np.where((whole > 0)[:, None] if start.ndim > 1 else whole > 0, sums / (by[:, None] if start.ndim > 1 else by), start))
    return out[0], out[1]


def fit(grams: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(key, p): the log10 probability of every window of settled counts (key, n); and weights and table."""
    sc = grams.sparkSession.sparkContext
    low = sc.broadcast(low_counts(grams))
    distinct = grams.where("n > 0").count()
    shards = max(1, -(-distinct // SHARD))
    dealt = grams.select("key", "n", F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF))), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.withColumn("times", F.col("n"))

    def shuffled(t: pa.Table) -> tuple[np.ndarray, ...]:
        w = t.column("key").to_numpy()
        at = np.argsort(w)
        at = at[np.random.default_rng(10).permutation(len(at))]
        return w[at], t.column("n").to_numpy()[at], t.column("times").to_numpy()[at]

    def learned(t: pa.Table) -> pa.Table:
        w, n, times = shuffled(t)
        pick = times > 0
        by_bit = [(z[pick], o[pick]) for z, o in counts_of(w, n, low.value)]
        got = learn(lambda i, j, bit: (by_bit[bit][0][i:j], by_bit[bit][1][i:j]), w[pick], times[pick])
        return pa.table({name: pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary()) for name, x in zip(("weights", "mass", "cells", "seen"), got)})

    weights, table_ = merged(dealt.groupBy("shard").applyInArrow(learned, _LEARNED).collect())
    sent = sc.broadcast((weights, table_))

    def scored(t: pa.Table) -> pa.Table:
        w, n, _ = shuffled(t)
        total = sum(bit_log(w, bit, list(log_odds(z, o).T), *sent.value) for bit, (z, o) in enumerate(counts_of(w, n, low.value)))
        return pa.table({"key": w, "n": n, "p": total / np.log(10)})

    return settle(dealt.groupBy("shard").applyInArrow(scored, "key bigint, n bigint, p double"), "lm-windows"), (weights, table_)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows (.., n) with the greatest n: ``most`` of them at most, all of an equal n or none.

    The least n comes from a histogram of a few thousand bins, so that nothing is
    sorted and no task gathers the rows.
    """
    bin_ = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.floor(4096 + 256 * F.log2(F.col("n") / 4096))).cast("bigint")
    room, least = most, None
    for r in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if r["rows"] > room:
            break
        room, least = room - r["rows"], r["bin"]
    return counts.where(F.lit(False)) if least is None else counts.where(bin_ >= least)


def lm_scores(docs: DataFrame, keep: list[str], text: str = "text", held_out: str = "held_out") -> DataFrame:
    """``keep`` of docs with _n_tokens, _n_known, _train_tokens, _base, _score and _n_bytes."""
    spark = docs.sparkSession
    counts = settle(corpus_counts(docs.select(F.col(text).alias("text"), F.col(held_out).alias("held_out"))), "lm-counts")
    tokens = counts.where(F.col("kind") == _TOKEN)
    texts = counts.where(F.col("kind") == 2).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n + texts, v + (texts > 0)
    windows, _ = fit(counts.where(F.col("kind") == _GRAM).select("key", "n"))
    near = most_frequent(windows, HEAD_WINDOWS).select("key", F.col("p").cast("float")).toArrow()
    near_key = near.column("key").to_numpy()
    by_key = np.argsort(near_key)
    head = most_frequent(tokens, HEAD_TOKENS).select("key", "n").toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast((head.column("key").to_numpy(), head.column("n").to_numpy(), near_key[by_key], near.column("p").to_numpy()[by_key]))
    del near, near_key, by_key
    fixed = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fixed, "_row bigint", "_n_tokens bigint", "_n_bytes bigint", "_known bigint", "_logs double", "_score double", "_rare array<struct<key:bigint,n:int>>", "_far array<struct<key:bigint,n:int>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ns, near_keys, near_p = sent.value
        logs = np.log10(ns + 1.0)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            all_texts = as_bytes(b.column(b.schema.get_field_index(text)))
            cols: list[list] = [[] for _ in range(6)]
            rare_key, rare_n, rare_size = [], [], []
            far_key, far_n, far_size = [], [], []
            for i, j in chunks(all_texts):
                part = all_texts[i:j]
                w = Words(part, lower=True)
                h, sizes = signed(w.hash), np.diff(w.offset)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                value = np.where(hit, logs[at], 0.0) if len(keys) else np.zeros(len(h))
                sums = np.concatenate([[0.0], np.cumsum(value)])
                known = np.concatenate([[0], np.cumsum(hit)])
                grams, spans = windows_of(part)
                u, back = np.unique(grams, return_inverse=True)
                place = np.minimum(np.searchsorted(near_keys, u), max(len(near_keys) - 1, 0))
                found = near_keys[place] == u if len(near_keys) else np.zeros(len(u), bool)
                value = np.where(found, near_p[place].astype(float), 0.0) if len(near_keys) else np.zeros(len(u))
                p, away = np.concatenate([[0.0], np.cumsum(value[back])]), None if found.all() else ~found[back]
                # Sums of a text, not differences of long sums: a text's score doesn't depend on its neighbours.
                for k in range(len(part)):
                    a, z = w.offset[k], w.offset[k + 1]
                    u, c = np.unique(h[a:z][~hit[a:z]], return_counts=True)
                    rare_key.append(u)
                    rare_n.append(c)
                    rare_size.append(len(u))
                    mine = grams[spans[k] : spans[k + 1]]
                    u, c = np.unique(mine[away[spans[k] : spans[k + 1]]] if away is not None else mine[:0], return_counts=True)
                    far_key.append(u)
                    far_n.append(c)
                    far_size.append(len(u))
                cols[0].append(sizes + 1)
                cols[1].append(np.fromiter(map(len, part), np.int64, len(part)))
                cols[2].append(known[w.offset[1:]] - known[w.offset[:-1]])
                cols[3].append(np.round(sums[w.offset[1:]] - sums[w.offset[:-1]], 9))
                cols[4].append(np.round(p[spans[1:]] - p[spans[:-1]], 9))
            if not all_texts:
                continue
            m = len(all_texts)
            rare, far = (pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(times).astype(np.int32))], names=["key", "n"])) for key, times, size in ((rare_key, rare_n, rare_size), (far_key, far_n, far_size)))
            made = [pa.array(np.arange(row, row + m)), *[pa.array(np.concatenate(c)) for c in cols[:5]], rare, far]
            row += m
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + made, names=[*keep, "_row", "_n_tokens", "_n_bytes", "_known", "_logs", "_score", "_rare", "_far"])

    rows = settle(docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema), "lm-rows")
    found = rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.key", F.col("r.n").alias("times"))
    rare = found.join(tokens.select("key", "n"), "key").groupBy("_row").agg(F.sum("times").alias("_rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_rare_logs"))
    away = rows.select("_row", F.explode("_far").alias("r")).select("_row", "r.key", F.col("r.n").alias("times"))
    far = away.join(windows.select("key", F.col("p").cast("float").cast("double").alias("p")), "key").groupBy("_row").agg(F.sum(F.col("times") * F.col("p")).alias("_far_score"))
    out = rows.drop("_rare", "_far").join(rare, "_row", "left").join(far, "_row", "left")
    known = F.col("_known") + F.coalesce("_rare_known", F.lit(0)) + F.lit(int(texts > 0))
    logs = F.col("_logs") + F.coalesce("_rare_logs", F.lit(0.0)) + F.lit(float(np.log10(texts + 1.0)))
    return out.select(*keep, "_n_tokens", "_n_bytes", known.cast("bigint").alias("_n_known"), F.lit(total).cast("bigint").alias("_train_tokens"), (logs - F.col("_n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("_base"), (F.col("_score") + F.coalesce("_far_score", F.lit(0.0))).alias("_score"))


def op10_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    out = lm_scores(docs.withColumn("held_out", held), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("_n_tokens").alias("n_tokens"), F.col("_n_known").alias("n_known"), F.col("_train_tokens").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"), (-F.col("_score") * float(np.log2(10)) / (F.col("_n_bytes") + 1)).alias("bits_per_byte"))
