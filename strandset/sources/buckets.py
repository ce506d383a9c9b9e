"""Sets and counters stored in buckets of their words' codes, so that algebra and lookups move no stored row.

A stored table is dealt to files by the hash of the code and sorted in each. Two tables of as many buckets are joined
bucket by bucket: neither is shuffled. Numbers of buckets are powers of two, so with
``spark.sql.bucketing.coalesceBucketsInJoin.enabled`` tables of unlike size need no shuffle either. k and whether words are canonical are stored
beside the words, and tables that differ in them are refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.operators import words as W
from strandset.operators.lineage import delete, discard, shuffles_freed, tell, told, written
from strandset.sources.reads import InvalidInput

#: Rows a bucket if the number of buckets is not given: about 40 MB of codes, some of which a task sorts at once.
ROWS_A_BUCKET = 4_000_000


@dataclass(frozen=True)
class StoredWords:
    """``table`` has code, and cnt or set_id if they were stored."""

    table: DataFrame
    k: int
    canonical: bool
    buckets: int
    path: str


def _write(rows: DataFrame, path: str, buckets: int, mode: str = "error") -> None:
    name = f"strandset_{uuid.uuid4().hex}"  # only the way to bucketed files; they stay when the name goes
    with shuffles_freed(rows.sparkSession):
        rows.repartition(buckets, "code").write.format("parquet").bucketBy(buckets, "code").sortBy("code").option("path", path).mode(mode).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def _read(spark: SparkSession, path: str, buckets: int, columns: str) -> DataFrame:
    name, place = f"strandset_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (code) SORTED BY (code) INTO {buckets} BUCKETS LOCATION '{place}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def store_words(words: DataFrame, path: str, k: int, canonical: bool = True, buckets: int | None = None, unlike: bool = False) -> None:
    """Writes (code or kmer, further columns), each row once; a null word raises InvalidInput.

    The rows are shuffled once, here; those that the caller knows to be ``unlike`` each other need no grouping before.
    Without ``buckets`` they are counted, and there are 8 or more, a power of two.
    """
    rest = [c for c in words.columns if c not in ("code", "kmer")]
    rows = words.select(W.bits_of(words).alias("code"), *rest)
    rows = written(rows if unlike else rows.distinct())
    if rows.where("code IS NULL").take(1):
        raise InvalidInput(f"{path}: a word is null or has other letters than A, C, G and T")
    if buckets is None:
        buckets = 8
        while buckets * ROWS_A_BUCKET < rows.count():
            buckets *= 2
    _write(rows, f"{path}/words", buckets)
    discard(rows)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    words.sparkSession.createDataFrame([(k, canonical, buckets, columns)], "k int, canonical boolean, buckets int, columns string").repartition(1).write.parquet(f"{path}/meta")


def open_words(spark: SparkSession, path: str) -> StoredWords:
    """Lazily: only the row on k, orientation and buckets is read at once."""
    k, canonical, buckets, columns = spark.read.parquet(f"{path}/meta").select("k", "canonical", "buckets", "columns").first()
    return StoredWords(_read(spark, f"{path}/words", buckets, columns), k, canonical, buckets, path)


def _agree(a: StoredWords, b: StoredWords) -> None:
    if (a.k, a.canonical) != (b.k, b.canonical):
        raise InvalidInput(f"{a.path} and {b.path} differ in k or in whether words are canonical")


def _both(a: StoredWords, b: StoredWords) -> DataFrame:
    """(code, in_a, in_b) of two stored sets."""
    _agree(a, b)
    left, right = a.table.select("code", F.lit(True).alias("in_a")), b.table.select("code", F.lit(True).alias("in_b"))
    return left.join(right, "code", "full")


def union(a: StoredWords, b: StoredWords) -> DataFrame:
    """(code)"""
    return _both(a, b).select("code")


def intersection(a: StoredWords, b: StoredWords) -> DataFrame:
    """(code)"""
    _agree(a, b)
    return W.intersection(a.table, b.table)


def difference(a: StoredWords, b: StoredWords) -> DataFrame:
    """(code): words of a that are not in b."""
    _agree(a, b)
    return W.difference(a.table, b.table)


def sizes(a: StoredWords, b: StoredWords) -> DataFrame:
    """(n_a, n_b, n_both, n_diff, equal) of two stored sets in one pass; a few numbers a bucket are moved."""
    found = _both(a, b).agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("n_both"))
    return found.select("*", (F.col("n_a") + F.col("n_b") - 2 * F.col("n_both")).alias("n_diff"), ((F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both"))).alias("equal"))


def lookup(counter: StoredWords, asked: DataFrame) -> DataFrame:
    """(code, cnt): the counts of asked words (code or kmer), 0 where there is none; only what is asked is shuffled."""
    return W.lookup(counter.table.select("code", "cnt"), asked.select(W.bits_of(asked).alias("code")))


def get(stored: StoredWords, asked: list[str]) -> DataFrame:
    """The stored rows of a few words named by the caller: only their buckets are read, and in them the row groups whose range holds one.

    Words are asked as they are written, or by their mirror images in a canonical set; those of another length raise InvalidInput.
    """
    turn = str.maketrans("ACGT", "TGCA")
    if any(len(w) != stored.k or set(w) - set("ACGT") for w in asked):
        raise InvalidInput(f"asked words must have {stored.k} bases")
    own = {min(w, w[::-1].translate(turn)) if stored.canonical else w for w in asked}
    return stored.table.where(F.col("code").isin(sorted(int(w.translate(str.maketrans("ACGT", "0123")), 4) for w in own)))


def _plus(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """(code, cnt): sums of two tables of counts, bucket by bucket if both are stored."""
    sum_ = F.coalesce("cnt", F.lit(0)) + F.coalesce("more", F.lit(0))
    clamped = sum_ if most is None else F.least(sum_, F.lit(most).cast("long"))
    return a.select("code", "cnt").join(b.select("code", F.col("cnt").alias("more")), "code", "full").select("code", clamped.alias("cnt"))


def add_batch(spark: SparkSession, path: str, batch: str, counts: DataFrame) -> None:
    """Adds the counts (code or kmer, cnt) of a named batch to the counter at ``path``.

    What is written is the sum of the batches so far, not the counter. It is told last, when its rows are complete, so a
    stopped batch does not count and can be run again; one that was told before is left as it is. Sums that no reader
    can have opened since the batch before go. Only one batch may be added at a time.
    """
    base, done = open_words(spark, path), told(spark, path)
    if batch in done.values():
        return
    code = F.coalesce(W.bits_of(counts), F.raise_error(F.lit(f"{path}: a word is null or has other letters than A, C, G and T")))
    rows = counts.select(code.alias("code"), "cnt").groupBy("code").agg(F.sum("cnt").cast("long").alias("cnt"))
    last = max(done, default=0)
    if last:
        rows = _plus(_added(base, last), rows)
    _write(rows, f"{path}/added-{last + 1}", base.buckets, "overwrite")
    tell(spark, path, last + 1, batch)
    delete(spark, f"{path}/added-{last - 1}")


def _added(base: StoredWords, at: int) -> DataFrame:
    return _read(base.table.sparkSession, f"{base.path}/added-{at}", base.buckets, "code BIGINT, cnt BIGINT")


def open_counts(spark: SparkSession, path: str, most: int = 255) -> StoredWords:
    """A counter with the batches added to it, clamped at ``most``; no row of either is shuffled."""
    base, last = open_words(spark, path), max(told(spark, path), default=0)
    return StoredWords(_plus(base.table, _added(base, last), most), base.k, base.canonical, base.buckets, path) if last else base
