"""Line dedup by prefix doubling over line sequences (operator 2).

A document is the sequence of its lines that hold a word; blank lines stay where
they are.  Positions start with the rank of their line.  Each round names the pair
of ranks of a position and of the one further on, so that the length that ranks
stand for doubles, and positions whose rank is unique leave; it ends past
``MIN_LINES``.  A rank's first position (by doc_id, row and line) is the copy that
stays.  Positions that share a rank with an earlier one open a repeated run of
MIN_LINES lines, and overlapping ones together are the maximal repeated runs - the
longest-common-prefix intervals of a suffix array cut at that length.  Later
copies are deleted; every deleted line keeps an equal one in an earlier place.

Names are 64-bit hashes of lines; a run needs MIN_LINES equal names in a row, or
one line of MIN_WORDS words: a passage that is a single long line is a run by itself.
Defined cases: a null or empty text has no lines and stays; a repeated row is a
later copy; ties (equal doc_id) go by row; a row of a null doc_id comes before the
others; a very long text is one row of its batch, read whole; other columns pass
through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from glyphlake.llm.common import as_bytes, settle, shield, table, tidy

#: Least number of lines of a repeated run.
MIN_LINES = 2
#: Words of a line that is a repeated run by itself.
MIN_WORDS = 10


def _with_lines(df: DataFrame, text: str, min_words: int | None = None) -> DataFrame:
    """df with _lines: the names of the lines that hold a word; and _long: which of them have min_words words."""
    schema = T.StructType([*df.schema.fields, T.StructField("_lines", T.ArrayType(T.LongType())), T.StructField("_long", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offsets, long_at, long_ends = [], [0], [], [0]
            for t in as_bytes(b.column(b.schema.get_field_index(text))):
                full = [x for x in t.split(b"\n") if x.strip()]
                ids += [xxhash.xxh64_intdigest(x) for x in full]
                offsets.append(len(ids))
                if min_words is not None:
                    long_at += [i for i, x in enumerate(full) if len(x.split()) >= min_words]
                long_ends.append(len(long_at))
            lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)))
            long = pa.ListArray.from_arrays(pa.array(long_ends, pa.int32()), pa.array(long_at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lines, long], names=schema.names)

    return df.mapInArrow(tidy(run), schema)


def later_runs(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(_row, pos): where min_lines lines begin that also begin earlier, from rows (_row, doc_id, _lines)."""
    ranks = lines.select("_row", "doc_id", F.posexplode("_lines").alias("pos", "rank"))
    size = 1
    while True:
        groups = ranks.groupBy("rank").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_row", "pos")).alias("first")).where("n > 1").drop("n")
        again = ranks.join(groups, "rank")
        if size >= min_lines:
            return again.where(~F.struct("doc_id", "_row", "pos").eqNullSafe(F.col("first"))).select("_row", "pos")
        ranks = settle(again.select("_row", "doc_id", "pos", "rank"), "lines-ranks")
        step = min(size, min_lines - size)
        onward = ranks.select("_row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("onward"))
        ranks = ranks.join(onward, ["_row", "pos"]).select("_row", "doc_id", "pos", F.xxhash64("rank", "onward").alias("rank"))
        size += step


def later_long_lines(lines: DataFrame) -> DataFrame:
    """(_row, pos): where long lines stand that also stand earlier, from rows (_row, doc_id, _lines, _long)."""
    ranks = lines.select("_row", "doc_id", "_lines", F.explode("_long").alias("pos")).select("_row", "doc_id", "pos", F.get("_lines", F.col("pos")).alias("rank"))
    first = F.struct("doc_id", "_row", "pos")
    groups = ranks.groupBy("rank").agg(F.count("*").alias("n"), F.min(first).alias("first")).where("n > 1").drop("n")
    return ranks.join(groups, "rank").where(~first.eqNullSafe(F.col("first"))).select("_row", "pos")


def line_dedup(df: DataFrame, text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """df with _kept_text (null if text is), _n_lines, _n_removed and _n_runs."""
    columns = df.columns
    rows = settle(_with_lines(df, text, min_words).withColumn("_row", F.monotonically_increasing_id()), "lines-rows")
    starts = later_runs(rows.select("_row", "doc_id", "_lines"), min_lines).groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("_starts"))
    joined = rows.drop("_lines", "_long").join(starts, "_row", "left")
    if min_words is not None:
        alone = later_long_lines(rows.select("_row", "doc_id", "_lines", "_long")).groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("_single"))
        joined = joined.join(alone, "_row", "left").drop("_row")
    else:
        joined = joined.withColumn("_single", F.lit(None).cast("array<int>")).drop("_row")
    schema = T.StructType([*df.schema.fields, T.StructField("_kept_text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("_n_lines", "_n_removed", "_n_runs")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, removed, runs = [], [], [], []
            column = b.column(b.schema.get_field_index(text))
            for t, null, starts, single in zip(as_bytes(column), column.is_null().to_pylist(), b.column(b.schema.get_field_index("_starts")), b.column(b.schema.get_field_index("_single"))):
                lines = t.split(b"\n")
                full = [i for i, x in enumerate(lines) if x.strip()]
                gone: set[int] = set()
                count, end = 0, -1
                spans = [(p, p + min_lines) for p in starts.as_py() or ()] + [(p, p + 1) for p in single.as_py() or ()]
                for p, stop in sorted(spans):
                    count += p > end
                    end = max(end, stop)
                    gone.update(full[p:stop])
                texts.append(None if null else b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "replace") if gone else t.decode("utf-8", "replace"))
                n_lines.append(len(full))
                removed.append(len(gone))
                runs.append(count)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in columns], pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (n_lines, removed, runs)]], names=schema.names)

    return joined.mapInArrow(tidy(run), schema)


def op2_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"), F.sha2(F.coalesce("_kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
full_line AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS n_words FROM line WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
pair AS (SELECT doc_id, pos, body, lead(body) OVER w AS onward FROM full_line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body, onward ORDER BY doc_id, pos) AS k FROM pair WHERE onward IS NOT NULL),
long_ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS k FROM full_line WHERE n_words >= {MIN_WORDS}),
gone AS (SELECT doc_id, pos FROM ranked WHERE k > 1 UNION SELECT doc_id, pos + 1 FROM ranked WHERE k > 1 UNION SELECT doc_id, pos FROM long_ranked WHERE k > 1),
opened AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone),
begun AS (SELECT doc_id, count(*) AS n_runs FROM opened WHERE before IS NULL OR pos > before + 1 GROUP BY 1),
mark AS (SELECT l.doc_id, l.i, l.body, f.pos IS NOT NULL AS has_word, g.pos IS NOT NULL AS is_gone FROM line l LEFT JOIN full_line f USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos)
SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (is_gone) AS n_removed, coalesce(max(n_runs), 0)::BIGINT AS n_runs,
  sha256(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (NOT is_gone), '')) AS kept_sha256
FROM mark LEFT JOIN begun USING (doc_id) GROUP BY doc_id
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what they have left; those left with no line at all, though they had some, go."""
    safe, back = shield(docs)
    out = line_dedup(safe).where("_n_removed = 0 or _n_removed < _n_lines")
    new = {"text": F.col("_kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_removed") > 0, F.char_length("_kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return back(out.withColumns(new))
