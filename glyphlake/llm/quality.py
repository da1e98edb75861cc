"""Quality rules with thresholds learned per language and source (operator 8).

Each rule looks at a share in thousandths (symbols, capitals, repeated lines,
repeated passages, words said twice in a row).  A mergeable quantile sketch per language and source - the
number of documents in each of 1001 equal bins, so that merging is addition, the
error is one thousandth and the order of the rows never matters - gives the
quantiles of a share over the documents that the fixed rules pass; a document
fails a rule when its share lies above ``median + SPREADS * max(quantile of the
rule - median, BIN)``.  Most documents have no repeated line or passage, so that
every low quantile of those shares is zero: ``RARE`` rules take theirs, with a
median of zero, from the shares that aren't.  Groups in which a rule's quantile
would rest on fewer than ``MIN_GROUP`` documents use the sketch of their
language, and languages with fewer that of the whole table.

Defined cases: a null text has no words and fails; null language or source is a
group of its own; repeated rows count and return once each; other columns pass
through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from glyphlake.llm.common import Words, as_bytes, chunks, settle, shield, table, tidy

#: Fixed rules of the contract: at least so many words; at most so many per cent of repeated words.
MIN_WORDS, MAX_REPEAT_PER_CENT, REPEAT_WINDOW = 20, 30, 8
#: The quantile whose distance to the median is a rule's spread, in per cent.
RULES = {"symbol": 75, "capital": 95, "dup_line": 25, "repeat": 25, "stutter": 95}
#: Rules whose quantile is that of the shares above zero.
RARE = ("dup_line", "repeat")
SPREADS = 4
#: The smallest spread: the error of the sketch, in thousandths.
BIN = 1
MIN_GROUP = 30
#: Threshold rows up to which the join is a broadcast (about 100 bytes a row); above, it is salted.
MAX_BROADCAST_GROUPS = 20_000
SALTS = 32

COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")
_SYMBOL, _CAPITAL, _BLANK, _LETTER_START = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL[65:91] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER_START[:] = [not 0x80 <= c < 0xC0 for c in range(256)]


def _within(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags of each text (the byte between two texts is blank and never counts)."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[bounds[1:]] - c[bounds[:-1]]


def count_texts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of some texts."""
    w = Words(texts)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    out["n_words"] = np.diff(w.offset)
    out["word_chars"] = _within(_LETTER_START[w.buf] & ~_BLANK[w.buf], w.text_start)
    out["n_symbols"] = _within(_SYMBOL[w.buf], w.text_start)
    out["n_capitals"] = _within(_CAPITAL[w.buf], w.text_start)
    same = np.zeros(len(w.hash) + 1, np.int64)  # words equal to the one before; the first of a text has none before
    if len(w.hash):
        equal = np.r_[False, w.hash[1:] == w.hash[:-1]]
        equal[w.offset[:-1][np.diff(w.offset) > 0]] = False
        np.cumsum(equal, out=same[1:])
    out["n_stutters"] = np.diff(same[w.offset])
    h, offset = w.windows(REPEAT_WINDOW)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_lines"][i] = len(lines)
        if len(lines) > 1:
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
        own = h[offset[i] : offset[i + 1]]
        if len(own) < 2:
            continue
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            covered = np.zeros(len(own) + REPEAT_WINDOW, np.int32)
            at = np.flatnonzero(np.isin(own, twice))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + REPEAT_WINDOW, -1)
            out["n_repeat_words"][i] = np.count_nonzero(np.cumsum(covered) > 0)
    return out


def counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) and the counts of ``text``, named ``_q_<count>``."""
    keep = df.columns if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(f"_q_{c}", T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(b.schema.get_field_index(text)))
            parts = [count_texts(texts[i:j]) for i, j in chunks(texts)]
            made = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + made, names=schema.names)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


def _share(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.least(F.lit(1000), F.expr(f"1000 * {part} div {whole}"))).otherwise(F.lit(0)).cast("int")


def _shares() -> dict:
    return {
        "symbol": _share("_q_n_symbols", "_q_word_chars"),
        "capital": _share("_q_n_capitals", "_q_word_chars"),
        "dup_line": _share("_q_n_dup_lines", "_q_n_lines"),
        "repeat": _share("_q_n_repeat_words", "_q_n_words"),
        "stutter": _share("_q_n_stutters", "_q_n_words"),
    }


def _base_failed():
    return (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > MAX_REPEAT_PER_CENT * F.col("_q_n_words"))


def sketches(counted: DataFrame) -> DataFrame:
    """Bins (_lang, _source, rule, bin, n): the mergeable sketches of every group, without what the fixed rules reject."""
    shares = F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("bin")) for r, s in _shares().items()])
    return counted.where(~_base_failed()).select("_lang", "_source", F.explode(shares).alias("x")).groupBy("_lang", "_source", "x.rule", "x.bin").agg(F.count("*").alias("n"))


def _limits(bins: DataFrame, by: list[str]) -> DataFrame:
    """Limit of each rule for every group, and the number of documents that its quantile rests on."""
    g = bins.groupBy(*by, "rule", "bin").agg(F.sum("n").alias("n"))
    rare = F.col("rule").isin(*RARE)
    g = g.where(~rare | (F.col("bin") > 0))
    w = Window.partitionBy(*by, "rule")
    g = g.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("size", F.sum("n").over(w))
    share = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("rule")]
    q = g.groupBy(*by, "rule").agg(
        F.max("size").alias("size"),
        F.min(F.when(F.col("upto") * 2 >= F.col("size"), F.col("bin"))).alias("mid"),
        F.min(F.when(F.col("upto") * 100 >= F.col("size") * share, F.col("bin"))).alias("high"),
    )
    mid = F.when(rare, F.lit(0)).otherwise(F.col("mid"))
    return q.select(*by, "rule", "size", (mid + SPREADS * F.greatest(F.col("high") - mid, F.lit(BIN))).alias("limit"))


def thresholds(bins: DataFrame) -> DataFrame:
    """One row per (_lang, _source): the limit of every rule, from the smallest group that is large enough."""
    rules = F.explode(F.array(*map(F.lit, RULES))).alias("rule")
    asked = bins.select("_lang", "_source").distinct().select("*", rules).alias("g")
    own = _limits(bins, ["_lang", "_source"]).alias("o")
    lang = _limits(bins, ["_lang"]).alias("l")
    every = _limits(bins, []).alias("e")
    j = asked.join(own, F.col("g._lang").eqNullSafe(F.col("o._lang")) & F.col("g._source").eqNullSafe(F.col("o._source")) & (F.col("g.rule") == F.col("o.rule")), "left")
    j = j.join(lang, F.col("g._lang").eqNullSafe(F.col("l._lang")) & (F.col("g.rule") == F.col("l.rule")), "left").join(every, F.col("g.rule") == F.col("e.rule"), "left")
    limit = F.when(F.col("o.size") >= MIN_GROUP, F.col("o.limit")).when(F.col("l.size") >= MIN_GROUP, F.col("l.limit")).otherwise(F.col("e.limit"))
    return j.select("g._lang", "g._source", "g.rule", limit.alias("limit")).groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("rule") == r, F.col("limit"))).alias(f"_limit_{r}") for r in RULES])


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Add _q_base_failed and _q_kept; limits is settled."""
    groups = limits.count()
    on = counted["_lang"].eqNullSafe(limits["_lang"]) & counted["_source"].eqNullSafe(limits["_source"])
    if groups <= MAX_BROADCAST_GROUPS:
        j = counted.join(F.broadcast(limits), on, "left")
    else:
        left = counted.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_q_word_chars"), F.lit(SALTS)))
        right = limits.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = left.join(right, left["_lang"].eqNullSafe(right["_lang"]) & left["_source"].eqNullSafe(right["_source"]) & (left["_salt"] == right["_r_salt"]), "left").drop("_salt", "_r_salt")
    ok = F.lit(True)
    for r, s in _shares().items():
        ok = ok & (s <= F.coalesce(F.col(f"_limit_{r}"), F.lit(1000)))
    failed = _base_failed()
    return j.drop(limits["_lang"], limits["_source"]).withColumn("_q_base_failed", failed).withColumn("_q_kept", ~failed & ok)


def quality_rules(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` with counts, base verdict and verdict, named ``_q_*``.

    Texts are read twice: once for the sketches, once with the thresholds at hand,
    so that no text is written or shuffled.
    """
    keep = df.columns if keep is None else keep
    grouped = df.withColumns({"_lang": F.col("lang"), "_source": F.col("source")})
    bins = settle(sketches(counts(grouped, keep=["_lang", "_source"])), "quality-bins")
    limits = settle(thresholds(bins), "quality-limits")
    out = judge(counts(grouped, keep=[*keep, "_lang", "_source"]), limits)
    return out.drop("_lang", "_source", *[f"_limit_{r}" for r in RULES])


def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    # The query returns no text, so what is counted is small: it is settled and read for both steps.
    grouped = docs.select("doc_id", F.col("lang").alias("_lang"), F.col("source").alias("_source"), "text")
    counted = settle(counts(grouped, keep=["doc_id", "_lang", "_source"]), "quality-counts")
    limits = settle(thresholds(sketches(counted)), "quality-limits")
    out = judge(counted, limits)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in base], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    safe, back = shield(docs)
    return back(quality_rules(safe).where("_q_kept"))
