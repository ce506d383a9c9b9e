"""Counting words of reads, and algebra on sets of words.

A table of words has a column ``kmer`` (the string) or ``code`` (2 bits a base, words of at most 31
letters); all operators take either. Codes are half the bytes to shuffle and are read off a fragment
by shifts, so counting goes by codes and spells out what is left (:func:`spelled`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions import kmer as K


def fragments(reads: DataFrame) -> DataFrame:
    """The parts of reads between Ns: the other columns, and frag (empty parts go)."""
    rest = [c for c in reads.columns if c != "seq"]
    return reads.select(*rest, F.explode(F.split("seq", "N")).alias("frag")).where("length(frag) > 0")


def word_column(words_: DataFrame) -> str:
    return "code" if "code" in words_.columns else "kmer"


def codes(strings: DataFrame, k: int, canonical: bool = True, column: str = "frag") -> DataFrame:
    """The codes of all words of length k <= 31, one row each; shorter strings have none.

    Strings are cut into overlapping pieces of 31 letters. A piece and its mirror image are coded once;
    the words of both are shifts of the two codes.
    """
    if not 1 <= k <= 31:
        raise ValueError("codes need 1 <= k <= 31")
    rest = [c for c in strings.columns if c != column]
    s, piece = F.col(column), F.col("__piece")
    starts = F.explode(F.sequence(F.lit(1), F.length(s) - (k - 1), F.lit(32 - k)))
    pieces = strings.where(F.length(s) >= k).select(*rest, s.alias("__s"), starts.alias("__at")).select(*rest, F.substring("__s", F.col("__at"), F.lit(31)).alias("__piece"))
    coded = pieces.select(*rest, F.length(piece).alias("__m"), K.encode(piece).alias("__f"), K.encode(K.reverse_complement(piece)).alias("__r"))
    at = coded.select("*", F.explode(F.sequence(F.lit(0), F.col("__m") - k)).alias("__j"))
    mask = F.lit((1 << (2 * k)) - 1)
    word = F.call_function("shiftright", F.col("__f"), 2 * (F.col("__m") - k - F.col("__j"))).bitwiseAND(mask)
    mirror = F.call_function("shiftright", F.col("__r"), 2 * F.col("__j")).bitwiseAND(mask)
    return at.select(*rest, (F.least(word, mirror) if canonical else word).alias("code"))


def spelled(words_: DataFrame, k: int) -> DataFrame:
    """The table with codes as strings."""
    return words_.select(*[K.decode(F.col("code"), k).alias("kmer") if c == "code" else c for c in words_.columns])


def words(strings: DataFrame, k: int, canonical: bool = True, column: str = "frag") -> DataFrame:
    """All words of length k, one row each; shorter strings have none."""
    if k <= 31:
        return spelled(codes(strings, k, canonical, column), k)
    rest = [c for c in strings.columns if c != column]
    s = F.col(column)
    at = strings.where(F.length(s) >= k).select(*rest, column, F.explode(F.sequence(F.lit(1), F.length(s) - (k - 1))).alias("__at"))
    word = F.substring(s, F.col("__at"), F.lit(k))
    return at.select(*rest, (K.canonical(word) if canonical else word).alias("kmer"))


def count_words(rows: DataFrame, most: int | None = 255, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, word, cnt): counts that stop at ``most``. Sums are partial first, then clamped once."""
    n = F.count("*")
    return rows.groupBy(*keys, word_column(rows)).agg((n if most is None else F.least(n, F.lit(most).cast("long"))).alias("cnt"))


def cut_off(counts: DataFrame, least: int) -> DataFrame:
    """The words counted ``least`` times or more; a cut-off beyond 0..255 is refused."""
    if not 0 <= least <= 255:
        raise ValueError("the cut-off must be within 0..255")
    return counts.where(F.col("cnt") >= least)


def n_dropped(counts: DataFrame, least: int) -> DataFrame:
    return counts.agg(F.count_if(F.col("cnt") < least).alias("n_dropped"), F.count_if(F.col("cnt") >= least).alias("n_kept"))


def add_counts(counts: DataFrame, more: DataFrame, most: int = 255) -> DataFrame:
    """Saturating sums of two counters."""
    word = word_column(counts)
    both = counts.select(word, "cnt").unionByName(more.select(word, "cnt"))
    return both.groupBy(word).agg(F.least(F.sum("cnt"), F.lit(most).cast("long")).alias("cnt"))


def lookup(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The counts of asked words, 0 where there is none."""
    word = word_column(counts)
    return asked.join(counts, word, "left").select(word, F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(word_column(a)).union(b.select(word_column(a))).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(word_column(a)).join(b.select(word_column(a)), word_column(a), "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(word_column(a)).join(b.select(word_column(a)), word_column(a), "left_semi")


def difference_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_diff, equal): words in one set only, by one aggregation over both."""
    word = word_column(a)
    sides = a.select(word, F.lit(1).alias("side")).union(b.select(word, F.lit(2).alias("side")))
    once = sides.groupBy(word).agg(F.sum("side").alias("side")).where("side <> 3")
    return once.agg(F.count("*").alias("n_diff"), (F.count("*") == 0).alias("equal"))


def contains(words_: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, contained) for every asked word."""
    word = word_column(words_)
    held = words_.select(word, F.lit(True).alias("held")).distinct()
    return asked.join(held, word, "left").select(word, F.col("held").isNotNull().alias("contained"))


def find(words_: DataFrame, condition: Column) -> DataFrame:
    return words_.where(condition)


def bits_of(words_: DataFrame) -> Column:
    """The code of each word."""
    return F.col("code") if "code" in words_.columns else K.encode(F.col("kmer"))


def statistics(words_: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, size, hash): the number of words and the XOR of their codes."""
    return words_.groupBy(*keys).agg(F.count("*").alias("size"), F.coalesce(F.bit_xor(bits_of(words_)), F.lit(0)).cast("long").alias("hash"))


def in_sample(bits: Column, k: int, n_bits: int, step: int = 50, offset: int = 7) -> Column:
    """Whether a word lies in every ``step``-th bucket: a deterministic sample of the buckets."""
    b = K.bucket(bits, k, n_bits)
    return (b % step == offset % step) & (b < step * (2**n_bits // step))


def sampled(words_: DataFrame, k: int, n_bits: int, step: int = 50, offset: int = 7) -> DataFrame:
    """The words of the sampled buckets (sampling is the operator's feature)."""
    return words_.where(in_sample(bits_of(words_), k, n_bits, step, offset))


def pair_weights(words_: DataFrame) -> DataFrame:
    """(i, j, weight): words shared by each two sets (i < j); rows may repeat.

    Words are grouped by the sets that hold them first, so pairs are made for each distinct group of
    sets, not for each word.
    """
    return pairs_of_classes(colour_classes(words_))


def pairs_of_classes(colours: DataFrame) -> DataFrame:
    """(i, j, weight) of classes (colour, cnt)."""
    i = colours.select("cnt", "colour", F.explode("colour").alias("i"))
    return i.select("cnt", "i", F.explode("colour").alias("j")).where("i < j").groupBy("i", "j").agg(F.sum("cnt").alias("weight"))


#: Sets whose words are grouped by masks of 63 sets a number; words of more are grouped with lists.
MASKED = 4 * 63


def set_masks(number: Column, n: int) -> dict[str, Column]:
    """The mask columns of one of n sets: a bit for each set, 63 a column."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number % 63)
    return {f"__mask{i}": F.when(F.floor(number / 63) == i, bit).otherwise(0) for i in range(-(-n // 63) or 1)}


def masked_names(names: list[str]) -> Column:
    """The names of the sets in the mask columns, in order."""
    own = [F.when(F.col(f"__mask{i // 63}").bitwiseAND(F.lit(1 << (i % 63))) != 0, F.lit(x)) for i, x in enumerate(names)]
    return F.array_compact(F.array(*own)).cast("array<string>")


def colour_classes(words_: DataFrame) -> DataFrame:
    """(colour, cnt): the sets that hold a word, in order, and the number of words with just these; rows may repeat.

    The sets' names come to the driver, if they are not too many for masks.
    """
    word = word_column(words_)
    names = [r["set_id"] for r in words_.select("set_id").where(F.col("set_id").isNotNull()).distinct().orderBy("set_id").limit(MASKED + 1).collect()]
    if len(names) > MASKED:
        of_word = words_.groupBy(word).agg(F.sort_array(F.collect_set("set_id")).alias("colour"))
        return of_word.groupBy("colour").agg(F.count("*").alias("cnt"))
    numbers = words_.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "set_id string, __set int")
    masks = set_masks(F.col("__set"), len(names))
    of_word = words_.join(F.broadcast(numbers), "set_id", "left").groupBy(word).agg(*[F.bit_or(bit).alias(m) for m, bit in masks.items()])
    return of_word.groupBy(*masks).agg(F.count("*").alias("cnt")).select(masked_names(names).alias("colour"), "cnt")


def named_classes(of_word: DataFrame, names: list[str | None]) -> DataFrame:
    """(colour, cnt) of words (code, held) whose sets are numbered; a null name is in no colour."""
    classes = of_word.groupBy("held").agg(F.count("*").alias("cnt"))
    numbers = of_word.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], "n int, name string")
    rows = classes.select("held", "cnt", F.explode("held").alias("n")).join(F.broadcast(numbers), "n")
    named = rows.groupBy("held").agg(F.sort_array(F.collect_list("name")).alias("colour"), F.first("cnt").alias("cnt"))
    return named.groupBy("colour").agg(F.sum("cnt").alias("cnt"))
