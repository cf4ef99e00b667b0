"""Table functions for SQL: `from reads, lateral kmers_of(reads.seq, 21)`."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .packing import ORDER
from .sequence import CODON_BASES, COMPLEMENTS, IUPAC, STANDARD_CODE

_TURNED = str.maketrans(IUPAC + IUPAC.lower(), COMPLEMENTS * 2)
_DIGITS = str.maketrans(ORDER, "0123")
_CODE = {a + b + c: STANDARD_CODE[16 * i + 4 * j + k] for i, a in enumerate(CODON_BASES) for j, b in enumerate(CODON_BASES) for k, c in enumerate(CODON_BASES)}


@udtf(returnType="pos int, kmer string, is_plus boolean")
class KmersOf:
    """pos (from 0), kmer (canonical, in letters) and is_plus of each window of k bases without other letters."""

    def eval(self, seq: str, k: int) -> Iterator[tuple]:
        seq = (seq or "").upper()
        back, n = seq.translate(_TURNED)[::-1], len(seq)
        last_bad = max((seq.rfind(c, 0, k - 1) for c in set(seq[: k - 1]) - set(ORDER)), default=-1)
        for pos in range(n - k + 1):
            if seq[pos + k - 1] not in ORDER:
                last_bad = pos + k - 1
            if last_bad < pos:
                ahead, turned = seq[pos : pos + k], back[n - pos - k : n - pos]
                plus = ahead.translate(_DIGITS) < turned.translate(_DIGITS)
                yield pos, ahead if plus else turned, plus


@udtf(returnType="frame int, protein string")
class FramesOf:
    """The six frames of a sequence: 1 to 3 as it stands, -1 to -3 of its reverse complement; X for an unknown codon."""

    def eval(self, seq: str) -> Iterator[tuple]:
        seq = (seq or "").upper()
        for sign, strand in ((1, seq), (-1, seq.translate(_TURNED)[::-1])):
            for frame in range(3):
                yield sign * (frame + 1), "".join(_CODE.get(strand[i : i + 3], "X") for i in range(frame, len(strand) - 2, 3))


def register(spark: SparkSession) -> None:
    spark.udtf.register("kmers_of", KmersOf)
    spark.udtf.register("frames_of", FramesOf)
