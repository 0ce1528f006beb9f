"""Nucleotide columns: codes, complements, k-mers, 2-bit packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUCS = "ACGT"


def clean(seq: Column) -> Column:
    """Upper-case alphabet ACGT; every other symbol counts as A, one for one."""
    return F.regexp_replace(F.translate(seq, "cgt", "CGT"), "[^CGT]", "A")


def digits(seq: Column) -> Column:
    """The sequence as a string of base-4 digits."""
    return F.translate(clean(seq), NUCS, "0123")


def codes(seq: Column) -> Column:
    return F.transform(F.split(digits(seq), ""), lambda c: c.cast("int"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(clean(seq), NUCS, "TGCA"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body and its lambdas use it."""
    return F.transform(F.array(value), body).getItem(0)


def kmer_codes(seq: Column, k: int) -> Column:
    """Base-4 value of every length-k window, in order of position."""

    def windows(arr: Column) -> Column:
        def value(i: Column) -> Column:
            out = F.lit(0)
            for j in range(k):
                out = out * 4 + F.get(arr, i + j)
            return out

        full = F.transform(F.sequence(F.lit(0), F.size(arr) - k), value)
        return F.when(F.size(arr) >= k, full).otherwise(F.array().cast("array<int>"))

    return let(codes(seq), windows)


def two_bit_hex(seq: Column) -> Column:
    """Four bases per byte, the first base in the lowest two bits, as hex text."""
    padded = F.rpad(digits(seq), (F.ceil(F.length(seq) / 4) * 4).cast("int"), "0")
    quads = F.regexp_extract_all(padded, F.lit("([0-3]{4})"), F.lit(1))
    byte = F.transform(quads, lambda q: F.lpad(F.conv(F.reverse(q), 4, 16), 2, "0"))
    return F.array_join(byte, "")


def two_bit(seq: Column) -> Column:
    return F.unhex(two_bit_hex(seq))
