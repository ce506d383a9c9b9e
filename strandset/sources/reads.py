"""Reads: from documents, from FASTA text, and sets of strings as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandset.operators.lineage import few, written

#: Each letter's base, ACGT in turn over the alphabet, the same for both cases.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_BASES = 2 * ("ACGT" * 7)[:26]


class InvalidInput(ValueError):
    """Input that breaks the format's rules."""


def reads_from_documents(docs: DataFrame) -> DataFrame:
    """(read_id, set_id, seq): the letters of each whole text as bases; accented letters become N."""
    letters = F.regexp_replace("text", "[^A-Za-zÀ-ɏ]", "")
    seq = F.regexp_replace(F.translate(letters, LETTERS, LETTER_BASES), "[^ACGT]", "N")
    return docs.select(F.col("doc_id").alias("read_id"), F.col("source").alias("set_id"), seq.alias("seq"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, read_id, seq) of FASTA files with two lines a record; gz and bz2 by extension.

    An odd number of lines, a header without ``>`` and a sequence with other characters than A, C, G, T,
    N raise InvalidInput. An empty file has no reads.

    A record is one row, cut off before the next line that begins with ``>``, so that Spark splits plain and bzip2
    files; only a gzip file is one task. Records are numbered within a split and by the splits before it.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    heads = F.min(F.struct("at", F.col("value").startswith(">").alias("marked"))).alias("head")
    splits = rows.groupBy("file", "block").agg(heads, F.max("at").alias("end"), F.count("*").alias("n"))
    of_file = Window.partitionBy("file")  # a row for each split of a file
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("block") == F.max("block").over(of_file)
    marked = F.min(F.struct("block", "head.marked")).over(of_file)["marked"]
    placed = written(splits.select("file", "block", F.col("head.at").alias("from"), F.when(last, F.col("end")).alias("last"), before.alias("before"), marked.alias("marked"), F.sum("n").over(of_file).alias("of")))
    ends = F.coalesce(F.col("at") == F.col("last"), F.lit(False))
    value = F.when(ends, F.regexp_replace("value", r"\n\z", "")).otherwise(F.col("value"))
    records = rows.join(few(placed), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("from")).alias("read_id"), value.alias("value"), "marked", "of")
    records = records.where("NOT (of = 1 AND value = '')")
    bad = records.where(~F.col("value").rlike(r"\A[^\n]*\n[ACGTN]*\z") | ~F.col("marked")).select("file").take(1)
    if bad:
        raise InvalidInput(f"{bad[0]['file']} is not FASTA with two lines a record over ACGTN")
    return records.select("file", "read_id", F.substring_index("value", "\n", -1).alias("seq"))


def write_strings(strings: DataFrame, path: str, compression: str = "none") -> None:
    """One string a line; compression is none, gzip or bzip2."""
    strings.select("seq").write.mode("error").option("compression", compression).text(path)


def load_strings(spark: SparkSession, path: str | list[str], k: int) -> DataFrame:
    """(seq): strings of sets from text files, all in one scan; shorter ones than k and other characters raise InvalidInput."""
    return load_files(spark, path, k).select("seq")


def load_files(spark: SparkSession, path: str | list[str], k: int) -> DataFrame:
    """(seq, file): :func:`load_strings` with the file of each string."""
    strings = spark.read.text(path).select(F.col("value").alias("seq"), F.col("_metadata.file_path").alias("file"))
    if strings.where((F.length("seq") < k) | ~F.col("seq").rlike("^[ACGT]+$")).take(1):
        raise InvalidInput(f"{path} holds a line that is no string of {k} or more bases")
    return strings
