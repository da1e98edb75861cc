"""Toxicity by a weighted lexicon (operator 9).

Texts are folded (case, homoglyphs, digits that stand for letters), punctuation
becomes white space, and one Aho-Corasick automaton finds the lexicon's words and
word beginnings together with exception phrases, which take back what they cover.
A text's features are the weights found, plain and normalised by length; a
logistic curve turns them into a score.

The lexicon, the exceptions and the curve are learned from labelled training rows:
a sample of at most ``MAX_TRAINING_ROWS`` (the least hashes of doc_id).  The curve is
fitted on a third of it with a lexicon of the rest, the lexicon then learned from
all of it.  Labels, language, source and doc_id are never inputs of a score.

Defined cases: a null or empty text scores like a text without matches; a text may
be of any length (it is folded and matched in one pass, in a few times its size);
entries of equal weight at one place count once; repeated rows return once each; a
repeated doc_id counts once in training, toxic if any of its labels says so;
without labelled rows of both kinds the lexicon is empty and every score is PRIOR;
other columns pass through score() whatever their names, but for the new one; an
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from glyphlake.llm.common import as_bytes, settle, table

#: Bounds of the sample that the model is fitted on, and of the lexicon and exceptions.
MAX_TRAINING_ROWS, MAX_LEXICON, MAX_EXCEPTIONS = 24_000, 3000, 500
#: A lexicon entry: in so many toxic texts at least, by so many standard errors and so much log odds.
MIN_TOXIC, MIN_Z, MIN_WEIGHT = 5, 5.0, 1.5
#: Lengths of word beginnings that may become entries.
STEMS = (4, 5, 6, 7, 8)
PRIOR = 0.1

# Characters that look like Latin letters (Cyrillic, Greek, full width).
_LOOKS = dict(zip("аеорсухіјѕԁһкмтвнαοερικντυχ", "aeopcyxijsdhkmtbhaoepikvtux"))
_LOOKS |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_LOOK_RE = re.compile(f"[{''.join(_LOOKS)}]")
_LOOK_MAP = {ord(k): v for k, v in _LOOKS.items()}
# Digits and signs that stand for letters.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
_ASCII = bytes(ord(_DIGITS[chr(c)]) if chr(c) in _DIGITS else c + 32 if 65 <= c <= 90 else 32 if c < 33 or c in b"!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~" else c for c in range(256))


def fold(text: bytes) -> str:
    """Words in lower case, one blank before and after each."""
    s = text.translate(_ASCII).decode("utf-8", "replace")
    if not s.isascii():
        s = s.lower()
        if _LOOK_RE.search(s):
            s = s.translate(_LOOK_MAP)
    return f" {' '.join(s.split())} "


def entries_of(folded: str) -> set[str]:
    """What of a text may become an entry: whole words (blank on both sides) and word beginnings."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if k < len(w))
    return out


class Lexicon:
    """Weighted entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: set[str]):
        self.automaton = ahocorasick.Automaton()
        for e, w in weights.items():
            self.automaton.add_word(e, (len(e.rstrip()), w))
        for e in exceptions:
            self.automaton.add_word(e, (len(e.rstrip()), None))
        self.empty = not weights
        if not self.empty:
            self.automaton.make_automaton()

    def features(self, folded: str) -> tuple[float, float, float, float]:
        """Sum and largest of the weights found (the best entry of each word), the sum per hundred words, and how many distinct words."""
        n = max(1, folded.count(" ") - 1)
        if self.empty:
            return 0.0, 0.0, 0.0, 0.0
        best: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, w) in self.automaton.iter(folded):
            end -= folded[end] == " "
            begin = end - size + 1
            if w is None:
                covered.append((begin, end))
            elif w > best.get(begin, 0.0):
                best[begin] = w
        for a, b in covered:
            for k in [k for k in best if a <= k <= b]:
                del best[k]
        if not best:
            return 0.0, 0.0, 0.0, 0.0
        by_word: dict[str, float] = {}
        for k, w in best.items():
            by_word[folded[k + 1 : folded.index(" ", k + 1)]] = w
        total = sum(best.values())
        return total, max(best.values()), 100.0 * total / n, sum(by_word.values())


def design(x: np.ndarray) -> np.ndarray:
    """Inputs of the curve from rows of features."""
    x = np.asarray(x, float).reshape(-1, 4)
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), x[:, 1], np.log1p(x[:, 2]), np.log1p(x[:, 3]), x[:, 0] > 0])


def _loss(d: np.ndarray, y: np.ndarray, b: np.ndarray, penalty: np.ndarray) -> float:
    x = d @ b
    return float((np.logaddexp(0, x) - y * x).sum() + 0.5 * (penalty * b * b).sum())


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the penalised loss falls."""
    d = design(x)
    b = np.zeros(d.shape[1])
    b[0] = np.log(PRIOR / (1 - PRIOR))
    if not len(y):
        return b
    penalty = np.full(len(b), ridge)
    penalty[0] = 1e-3
    now = _loss(d, y, b, penalty)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(d @ b, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * b)
        size = 1.0
        while size > 1e-9 and not (new := _loss(d, y, b + size * step, penalty)) < now:
            size /= 2
        if size <= 1e-9 or np.abs(size * step).max() < 1e-8:
            break
        b, now = b + size * step, new
    return b


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most MAX_TRAINING_ROWS training rows (text, toxic, first), settled."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (held != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING_ROWS)  # of bounded size, so broadcast
    # One row a doc_id, of the least text, so that repeated ones keep the bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return settle(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("first")), "toxic-sample")


_COUNTERS = ("toxic_first", "clean_first", "toxic_all", "clean_all")


def _counts(sample: DataFrame, entries) -> DataFrame:
    """(entry, and COUNTERS: texts of each class with it, among the first part and among all); '' counts all. entries: folded text -> set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = {(part, y): Counter() for part in (False, True) for y in (0, 1)}
            for t, y, first in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = counts[first, y]
                c[""] += 1
                c.update(entries(fold(t)))
            keys = list(set().union(*counts.values()))
            of = [[counts[True, y][k] for k in keys] for y in (1, 0)]
            of += [[n + counts[False, y][k] for k, n in zip(keys, x)] for y, x in zip((1, 0), of)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())] + [pa.array(x, pa.int64()) for x in of], names=["entry", *_COUNTERS])

    made = sample.select("text", "toxic", "first").mapInArrow(run, "entry string, " + ", ".join(f"{c} bigint" for c in _COUNTERS))
    return made.groupBy("entry").agg(*[F.sum(c).alias(c) for c in _COUNTERS])


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], set[str], np.ndarray]:
    """Weights, exception phrases and curve.

    The curve is fitted on the second part of the sample with a lexicon of the first;
    the lexicon that is returned is learned in the same way from the whole sample.
    """
    sample = _sample(docs, labels)
    found = settle(_counts(sample, entries_of), "toxic-entries")
    totals = found.where("entry = ''").collect()
    if not totals or not totals[0]["toxic_first"] or not totals[0]["clean_first"]:
        return {}, set(), fit_curve(np.zeros((0, 4)), np.zeros(0))
    size = totals[0].asDict()

    def weighted(part: str) -> dict[str, float]:
        t, c, toxic, clean = size[f"toxic_{part}"], size[f"clean_{part}"], F.col(f"toxic_{part}"), F.col(f"clean_{part}")
        rate = (toxic + clean + 1) / F.lit(t + c + 2)
        scored = found.where((F.col("entry") != "") & (toxic >= MIN_TOXIC)).select(
            "entry",
            F.log(((toxic + 0.3) / (t + 0.6)) / ((clean + 0.3) / (c + 0.6))).alias("w"),
            ((toxic / t - clean / c) / F.sqrt(rate * (1 - rate) * (1 / t + 1 / c))).alias("z"),
        )
        rows = scored.where((F.col("z") >= MIN_Z) & (F.col("w") >= MIN_WEIGHT)).orderBy(F.desc("z"), "entry").limit(MAX_LEXICON).collect()
        return {r["entry"]: float(r["w"]) for r in rows}

    weights = {part: weighted(part) for part in ("first", "all")}
    starts = tuple(sorted({e.strip() for w in weights.values() for e in w}, key=len))

    def phrases(folded: str) -> set[str]:
        w = folded.split()
        return {f" {w[i]} {w[i + 1]} " for i in range(len(w) - 1) if w[i].startswith(starts) or w[i + 1].startswith(starts)}

    exceptions: dict[str, set[str]] = {part: set() for part in weights}
    if starts:
        met = settle(_counts(sample, phrases), "toxic-phrases")
        for part in weights:
            clean = F.col(f"clean_{part}")
            benign = met.where((F.col("entry") != "") & (clean >= 3) & (clean / size[f"clean_{part}"] > 3 * F.col(f"toxic_{part}") / size[f"toxic_{part}"]))
            exceptions[part] = {r["entry"] for r in benign.orderBy(F.desc(f"clean_{part}"), "entry").limit(MAX_EXCEPTIONS).collect()}
    lexicon = (weights["first"], exceptions["first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*lexicon)
        for b in batches:
            x = np.array([lex.features(fold(t)) for t in as_bytes(b.column(0))], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)] + [b.column(1)], names=["a", "b", "c", "d", "toxic"])

    got = sample.where("not first").select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "a double, b double, c double, d double, toxic int").toPandas()
    got = got.sort_values(list(got.columns))  # the order of the rows must not matter
    return weights["all"], exceptions["all"], fit_curve(got[["a", "b", "c", "d"]].to_numpy(), got["toxic"].to_numpy(float))


def score(df: DataFrame, weights: dict[str, float], exceptions: set[str], curve: np.ndarray, text: str = "text", into: str = "_score") -> DataFrame:
    """``df`` with a score of ``text`` added as ``into``."""
    rest = [c for c in df.columns if c != into]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.DoubleType())])
    model = df.sparkSession.sparkContext.broadcast((weights, exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*model.value)
        for b in batches:
            texts = as_bytes(b.column(b.schema.get_field_index(text)))
            x = np.array([lex.features(fold(t)) for t in texts], float).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(design(x) @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in rest] + [pa.array(p, pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = score(docs, *model).drop("text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))
