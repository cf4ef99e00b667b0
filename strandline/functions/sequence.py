"""Scalar functions over sequences as column expressions. Bases are ordered A < C < T < G."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# IUPAC codes, their complements and what they stand for; the standard genetic code by base order TCAG.
IUPAC, COMPLEMENTS = "ACGTKMRYDVHBNWS", "TGCAMKYRHBDVNWS"
STANDS_FOR = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
CODON_BASES = "TCAG"
START_CODONS, STOP_CODONS = ("TTG", "CTG", "ATG"), ("TAA", "TAG", "TGA")
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def complement(seq: Column) -> Column:
    return F.translate(F.upper(seq), IUPAC, COMPLEMENTS)


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def digits(seq: Column) -> Column:
    """The sequence in digits that compare like its bases."""
    return F.translate(seq, "ACTG", "0123")


def bases(digits: Column) -> Column:
    return F.translate(digits, "0123", "ACTG")


def is_plus(kmer: Column) -> Column:
    """Whether a k-mer comes strictly before its reverse complement; a palindrome doesn't."""
    return digits(kmer) < digits(revcomp(kmer))


def canonical(kmer: Column) -> Column:
    return F.when(is_plus(kmer), kmer).otherwise(revcomp(kmer))


def entropy(seq: Column) -> Column:
    """Shannon entropy to the base 4 of the whole length; letters other than ACGT count for the length only."""
    upper, n = F.upper(seq), F.length(seq).cast("double")
    terms = []
    for base in "ACGT":
        p = (n - F.length(F.replace(upper, F.lit(base))) + F.lit(1e-8)) / n
        terms.append(-p * F.ln(p) / F.ln(F.lit(4.0)))
    return F.when(n > 0, reduce(lambda a, b: a + b, terms)).otherwise(F.lit(0.0))


def translate_codons(seq: Column) -> Column:
    """Amino acids of the whole codons of a sequence; X for a codon with other letters than ACGT."""
    places = F.sequence(F.lit(0), F.floor(F.length(seq) / 3).cast("int") - 1)

    def amino(i: Column) -> Column:
        at = reduce(lambda a, b: a * 4 + b, (F.instr(F.lit(CODON_BASES), F.upper(F.substr(seq, i * 3 + p, F.lit(1)))) - 1 for p in (1, 2, 3)))
        known = reduce(lambda a, b: a & b, (F.instr(F.lit(CODON_BASES), F.upper(F.substr(seq, i * 3 + p, F.lit(1)))) > 0 for p in (1, 2, 3)))
        return F.when(known, F.substr(F.lit(STANDARD_CODE), at + 1, F.lit(1))).otherwise(F.lit("X"))

    return F.when(F.length(seq) >= 3, F.array_join(F.transform(places, amino), "")).otherwise(F.lit(""))


def codons(seq: Column) -> Column:
    """The whole codons of a sequence."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.upper(seq), i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def is_start(codon: Column) -> Column:
    return codon.isin(*START_CODONS)


def is_stop(codon: Column) -> Column:
    return codon.isin(*STOP_CODONS)


def codons_for(amino: str) -> list[str]:
    """The codons of an amino acid, in the order of the code."""
    each = [a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES]
    return [c for c, x in zip(each, STANDARD_CODE, strict=True) if x == amino.upper()]


def frames(seq: Column) -> Column:
    """Array of struct frame, protein: the three frames of the sequence and of its reverse complement (-1 to -3)."""
    both = [(n + 1, F.substr(seq, F.lit(n + 1))) for n in range(3)] + [(-n - 1, F.substr(revcomp(seq), F.lit(n + 1))) for n in range(3)]
    return F.array(*(F.struct(F.lit(n).alias("frame"), translate_codons(s).alias("protein")) for n, s in both))


def expand_iupac(code: Column) -> Column:
    """The bases that a code stands for, sorted; itself for other letters."""
    return F.coalesce(reduce(lambda c, kv: c.when(F.upper(code) == kv[0], F.lit(kv[1])), STANDS_FOR.items(), F.when(F.lit(False), F.lit(""))), F.upper(code))


def collapse_iupac(letters: Column) -> Column:
    """The code of a sorted set of bases."""
    return reduce(lambda c, kv: c.when(F.upper(letters) == kv[1], F.lit(kv[0])), STANDS_FOR.items(), F.when(F.lit(False), F.lit("")))


def iupac_match(a: Column, b: Column) -> Column:
    """Whether the sorted bases of one code contain those of the other as a substring."""
    x, y = expand_iupac(a), expand_iupac(b)
    return x.contains(y) | y.contains(x)


def longest_clean_run(seq: Column) -> Column:
    """The longest run of ACGT, the first of equally long ones."""
    return F.aggregate(F.split(F.upper(seq), "[^ACGT]+"), F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))


def valid_symbols(seq: Column) -> Column:
    return ~F.rlike(seq, F.lit("(?i)[^ACGTYRWSKMDVHBXN-]"))


def register(spark: SparkSession) -> None:
    """SQL names for what has no built-in one."""
    spark.sql("create or replace temporary function revcomp(s string) returns string return reverse(translate(upper(s), '%s', '%s'))" % (IUPAC, COMPLEMENTS))
    spark.sql("create or replace temporary function base_digits(s string) returns string return translate(s, 'ACTG', '0123')")
    spark.sql("create or replace temporary function canonical_kmer(s string) returns string return if(base_digits(s) < base_digits(revcomp(s)), s, revcomp(s))")
    entropy_of = " + ".join(f"-p{b} * ln(p{b}) / ln(4D)" for b in "ACGT")
    parts = ", ".join(f"(length(s) - length(replace(upper(s), '{b}', '')) + 1e-8D) / length(s) as p{b}" for b in "ACGT")
    spark.sql(f"create or replace temporary function dna_entropy(s string) returns double return (select if(length(s) > 0, {entropy_of}, 0D) from (select {parts}))")
    pick = " + ".join(f"{4 ** (2 - p)} * (instr('{CODON_BASES}', substr(c, {p + 1}, 1)) - 1)" for p in range(3))
    amino = f"if(c rlike '^[ACGT]+$', substr('{STANDARD_CODE}', {pick} + 1, 1), 'X')"
    cut = "transform(sequence(0, cast(length(s) div 3 as int) - 1), i -> substr(upper(s), i * 3 + 1, 3))"
    spark.sql(f"create or replace temporary function translate_codons(s string) returns string return if(length(s) >= 3, array_join(transform({cut}, c -> {amino}), ''), '')")
