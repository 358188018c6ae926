"""Bit vectors as arrays of 64-bit words, the first bit of a word in its highest place: packing, counts before a place, lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

WORD_BITS = 64


def packed(bits: Column) -> Column:
    """The words of a text of 0 and 1; the last one is filled with 0. An empty text has none, null gives null."""
    word = lambda x: F.conv(F.rpad(x, WORD_BITS, "0"), 2, -10).cast("long")
    return F.transform(F.regexp_extract_all(bits, F.lit(f"[01]{{1,{WORD_BITS}}}"), F.lit(0)), word)


def bits_of(text: Column, symbols: str) -> Column:
    """A text of 0 and 1, one for each character of text: 1 where it is one of symbols."""
    code = lambda c: f"\\x{{{ord(c):x}}}"
    other = next(c for c in "0ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in symbols)  # stands for all characters outside symbols
    marked = F.regexp_replace(text, f"[^{''.join(map(code, symbols))}]", other)
    return F.translate(F.regexp_replace(marked, f"[^{other}]", "1"), other, "0")


def rank1(words: Column, i: Column) -> Column:
    """Set bits before place i (from 0); past the end: all."""
    full, rest = F.floor(i / WORD_BITS).cast("int"), (i % WORD_BITS).cast("int")
    before = lambda w: F.aggregate(F.slice(w, F.lit(1), full), F.lit(0), lambda n, x: n + F.bit_count(x))
    part = lambda w: F.when(rest > 0, F.bit_count(F.call_function("shiftrightunsigned", F.get(w, full), F.lit(WORD_BITS) - rest)))
    return let(words, lambda w: (before(w) + F.coalesce(part(w), F.lit(0))).cast("long"))


def bit_at(words: Column, i: Column) -> Column:
    """The bit at place i (from 0) as a boolean; null outside the words."""
    full, rest = F.floor(i / WORD_BITS).cast("int"), (i % WORD_BITS).cast("int")
    return F.call_function("shiftrightunsigned", F.get(words, full), F.lit(WORD_BITS - 1) - rest).bitwiseAND(F.lit(1)) == 1
