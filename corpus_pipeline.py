"""A training-data pipeline over `documents`: each stage works on what the one before has kept."""

from __future__ import annotations

from glyphlake.llm import bpe, contamination, linededup, neardup, quality
from glyphlake.llm.common import settle, table

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("minhash_near_dedup", neardup.stage),
    ("benchmark_decontamination", contamination.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL can't express SimHash windows or byte-pair merges; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order; each result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
