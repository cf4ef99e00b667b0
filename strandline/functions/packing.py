"""K-mers as keys: two bits a base in a long up to 31 bases, a string of digits beyond; both compare like A < C < T < G."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that fit into a signed long; the order of bases as digits.
MOST_PACKED, ORDER = 31, "ACTG"


def _left(x: Column, by: int) -> Column:
    return F.shiftleft(x, by)


def _right(x: Column, by: int) -> Column:
    return F.shiftrightunsigned(x, by)


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _swapped(x: Column) -> Column:
    """The 32 pairs of bits of a long from behind: neighbours are swapped, then twos, fours, eights and halves."""
    for bits in (2, 4, 8, 16):
        low = sum(((1 << bits) - 1) << at for at in range(0, 64, 2 * bits))
        x = _and(_right(x, bits), low).bitwiseOR(_left(_and(x, low), bits))
    return _right(x, 32).bitwiseOR(_left(x, 32))


@dataclass(frozen=True)
class Packing:
    """Expressions over k-mers of k bases."""

    k: int

    @property
    def wide(self) -> bool:
        return self.k > MOST_PACKED

    @property
    def type(self) -> str:
        return "string" if self.wide else "long"

    def text(self, kmer: Column) -> Column:
        """The letters of a k-mer."""
        digits = kmer if self.wide else F.lpad(F.conv(kmer.cast("string"), 10, 4), self.k, "0")
        return F.translate(digits, "0123", ORDER)

    def parse(self, text: Column) -> Column:
        digits = F.translate(text, ORDER, "0123")
        return digits if self.wide else F.conv(digits, 4, 10).cast("long")

    def revcomp(self, kmer: Column) -> Column:
        if self.wide:
            return F.reverse(F.translate(kmer, "0123", "2301"))
        complement = kmer.bitwiseXOR(F.lit(sum(2 << 2 * i for i in range(self.k))).cast("long"))  # it is two away
        return _right(_swapped(complement), 64 - 2 * self.k)

    def canonical(self, kmer: Column) -> Column:
        return F.least(kmer, self.revcomp(kmer))

    def step(self, kmer: Column, nt: Column) -> Column:
        """The next k-mer by a base, given as its digit."""
        if self.wide:
            return F.concat(F.substring(kmer, 2, self.k), nt.cast("string"))
        return _left(self.suffix(kmer), 2).bitwiseOR(nt.cast("long"))

    def prefix(self, kmer: Column) -> Column:
        """All bases but the last."""
        return F.substring(kmer, 1, self.k - 1) if self.wide else _right(kmer, 2)

    def suffix(self, kmer: Column) -> Column:
        """All bases but the first."""
        return F.substring(kmer, 2, self.k) if self.wide else _and(kmer, (1 << 2 * (self.k - 1)) - 1)

    def join(self, first: Column, suffix: Column) -> Column:
        """A base, given as its digit, before the suffix of a k-mer."""
        return F.concat(first.cast("string"), suffix) if self.wide else _left(first.cast("long"), 2 * (self.k - 1)).bitwiseOR(suffix)

    def extend(self, prefix: Column, last: Column) -> Column:
        """A base, given as its digit, behind the prefix of a k-mer."""
        return F.concat(prefix, last.cast("string")) if self.wide else _left(prefix, 2).bitwiseOR(last.cast("long"))

    def first(self, kmer: Column) -> Column:
        """The digit of the first base."""
        return (F.substring(kmer, 1, 1) if self.wide else _right(kmer, 2 * (self.k - 1))).cast("int")

    def last(self, kmer: Column) -> Column:
        """The digit of the last base."""
        return (F.substring(kmer, self.k, 1) if self.wide else _and(kmer, 3)).cast("int")

    def tail(self, kmer: Column, bases: str) -> Column:
        """Whether a k-mer ends in these bases."""
        if self.k < len(bases):
            return F.lit(False)
        digits = bases.translate(str.maketrans(ORDER, "0123"))
        return kmer.endswith(digits) if self.wide else _and(kmer, (1 << 2 * len(bases)) - 1) == int(digits, 4)
