"""Incremental counting of words over streams of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.operators.words import codes, fragments, spelled


def count_stream(reads: DataFrame, k: int, canonical: bool = True, most: int = 255) -> DataFrame:
    """(kmer, cnt): saturating counts over a stream of reads (seq); write it in update or complete mode.

    State is one row a word, partitioned by word; the whole count is kept and clamped on the way out, so
    that any order of arrival gives the counts of one batch.
    """
    found = codes(fragments(reads), k, canonical)
    return spelled(found.groupBy("code").agg(F.least(F.count("*"), F.lit(most).cast("long")).alias("cnt")), k)
