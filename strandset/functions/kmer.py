"""Column functions on DNA words (k-mers): strings over A, C, G, T, or their 2-bit codes as longs.

All are built-in expressions, so they stay in whole-stage codegen. The order of the strings is the
order of the codes. Null in, null out.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def encode(kmer: Column) -> Column:
    """2 bits a base, the first base highest; k <= 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


#: All strings of four letters in order.
_FOURS = ",".join(map("".join, product(BASES, repeat=4)))


def decode(bits: Column, k: int) -> Column:
    """The k letters of a code, looked up by four."""
    fours = F.split(F.lit(_FOURS), ",")  # folded to one literal by the optimizer
    parts = [F.get(fours, F.shiftright(bits, 2 * low).bitwiseAND(F.lit(255)).cast("int")) for low in range(k // 4 * 4 - 4, -1, -4)]
    if k % 4:
        parts.insert(0, F.right(F.get(fours, F.shiftright(bits, 2 * (k - k % 4)).bitwiseAND(F.lit(255)).cast("int")), F.lit(k % 4)))
    return F.concat(*parts)


def reverse_complement_code(bits: Column, k: int) -> Column:
    """The code of the reverse complement: pairs of bits are swapped in blocks, then all inverted."""
    for size, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        bits = F.shiftrightunsigned(bits, size).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(bits.bitwiseAND(F.lit(mask)), size))
    return F.shiftrightunsigned(bits, 64 - 2 * k).bitwiseXOR(F.lit((1 << (2 * k)) - 1))


def last_base(kmer: Column) -> Column:
    return F.right(kmer, F.lit(1))


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def following(kmer: Column, base: str | Column) -> Column:
    """The word one base on: the first base goes, ``base`` is appended."""
    return F.concat(F.substring(kmer, 2, F.length(kmer)), F.lit(base) if isinstance(base, str) else base)


def preceding(kmer: Column, base: str | Column, k: int) -> Column:
    return F.concat(F.lit(base) if isinstance(base, str) else base, F.substring(kmer, 1, k - 1))


def successors(kmer: Column) -> Column:
    return F.array(*[following(kmer, b) for b in BASES])


def predecessors(kmer: Column, k: int) -> Column:
    return F.array(*[preceding(kmer, b, k) for b in BASES])


def bucket(bits: Column, k: int, n_bits: int) -> Column:
    """The top ``n_bits`` of the code."""
    return F.shiftright(bits, 2 * k - n_bits)


def bucket_key(bits: Column, k: int, n_bits: int) -> Column:
    return bits.bitwiseAND(F.lit((1 << (2 * k - n_bits)) - 1))


def from_bucket(bucket_: Column, key: Column, k: int, n_bits: int) -> Column:
    return F.shiftleft(bucket_.cast("long"), 2 * k - n_bits) + key


def saturating_add(a: Column, b: Column, most: int = 255) -> Column:
    return F.least(a + b, F.lit(most).cast("long"))


def joined_path(parts: Column, k: int) -> Column:
    """Strings that overlap by k - 1 characters, as one: the first whole, the others without the overlap."""
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, k, F.length(x)))), "")


def n_words(seq: Column, k: int) -> Column:
    return F.greatest(F.length(seq) - (k - 1), F.lit(0)).cast("long")
