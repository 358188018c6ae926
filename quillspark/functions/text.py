"""Substring arithmetic on columns: counts, byte positions and whole-character windows, all inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def regex_of(pattern: str) -> str:
    """A Java regular expression for the literal pattern."""
    return re.escape(pattern)


def overlaps_itself(pattern: str) -> bool:
    """Whether two occurrences of the pattern can share characters."""
    return any(pattern.startswith(pattern[k:]) for k in range(1, len(pattern)))


def count_nonoverlapping(text: Column, pattern: str) -> Column:
    """Occurrences from left to right that share nothing; 0 for the empty pattern; null texts count 0."""
    if not pattern:
        return F.lit(0).cast("long")
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(pattern), F.lit("")))
    n = F.floor(gone / F.lit(len(pattern.encode())))
    return F.coalesce(F.when(F.contains(text, F.lit(pattern)), n), F.lit(0)).cast("long")


def count_overlapping(text: Column, pattern: str) -> Column:
    """Every offset at which the pattern starts. Patterns that cannot overlap themselves take the byte-wise way."""
    if not overlaps_itself(pattern):
        return count_nonoverlapping(text, pattern)
    n = F.regexp_count(text, F.lit(f"(?={regex_of(pattern)})"))
    return F.coalesce(F.when(F.contains(text, F.lit(pattern)), n), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array<bigint>. Sums run within chunks, then over the chunks, so long arrays stay cheap."""
    return let(values, _running_sums)


def _running_sums(values: Column) -> Column:
    empty = F.array().cast("array<bigint>")

    def within(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), empty.alias("out"))
        step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out"))
        return F.aggregate(F.slice(values, at, F.lit(_CHUNK)), start, step)

    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_CHUNK)), within)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<array<bigint>>").alias("out"))
    join = lambda a, p: F.struct((a["s"] + p["s"]).alias("s"), F.concat(a["out"], F.array(F.transform(p["out"], lambda x: x + a["s"]))).alias("out"))
    return F.aggregate(parts, start, join, lambda a: F.flatten(a["out"]))


def stretches(text: Column, pattern: str) -> Column:
    """The text cut before each occurrence, overlapping ones included; the first part is empty or holds no occurrence's start."""
    return F.split(text, f"(?={regex_of(pattern)})", -1)


def positions(text: Column, pattern: str, chars: bool = False) -> Column:
    """0-based offsets of all occurrences, ascending: in bytes of UTF-8, or in characters."""
    if not pattern:
        return F.array().cast("array<bigint>")
    size = F.length if chars else F.octet_length
    parts = stretches(text, pattern)
    ends = running_sums(F.transform(parts, lambda p: size(p).cast("long")))
    starts = let(ends, lambda e: F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))))
    # a text that begins with the pattern is not cut at its start
    first = F.when(F.startswith(text, F.lit(pattern)), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    found = F.concat(first, starts)
    return F.when(F.contains(text, F.lit(pattern)), found).otherwise(F.array().cast("array<bigint>"))


def _whole(b: Column, start: Column, size: Column, from_left: bool) -> Column:
    """The longest stretch of whole characters in size bytes from start: cut on the left or on the right end."""
    tries = []
    for k in range(4):
        at, n = (start + k, size - k) if from_left else (start, size - k)
        tries.append(F.when(n > 0, F.try_validate_utf8(F.substring(b, (at + 1).cast("int"), n.cast("int")).cast("string"))))
    return F.coalesce(*tries, F.lit(""))


def window_before(b: Column, at: Column, width: int) -> Column:
    """The longest whole-character end of the bytes before `at` with at most width bytes."""
    start = F.greatest(at - width, F.lit(0).cast("long"))
    return _whole(b, start, at - start, True)


def window_after(b: Column, at: Column, width: int) -> Column:
    """The longest whole-character beginning of the bytes from `at` on with at most width bytes."""
    return _whole(b, at, F.least(F.lit(width).cast("long"), F.octet_length(b) - at), False)


def extract_bytes(text: Column, start: int, size: int) -> Column:
    """Bytes [start, start + size) as binary, clipped to the text."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, size) if size > 0 else F.lit(b"").cast("binary")


def flat(text: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def rstrip(line: Column) -> Column:
    """Without white space at the end, Unicode's and the separators U+001C to U+001F included."""
    return F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+$", "")


# White space by Unicode, with the separators U+001C to U+001F and without the line end U+000A.
_BLANKS = r"[\x20\t\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def rstrip_lines(text: Column) -> Column:
    """rstrip of every line of a text (lines end at U+000A alone). Texts are first asked, from their line ends, whether a line has any
    white space there; then a run of it is looked at once, from its first character."""
    some = text.rlike(rf"\n(?<={_BLANKS}\n)") | F.right(text, F.lit(1)).rlike(_BLANKS)
    return F.when(some, F.regexp_replace(text, rf"{_BLANKS}(?<!{_BLANKS}{_BLANKS}){_BLANKS}*+(?=\n|\z)", "")).otherwise(text)


def fnv1a(b: Column) -> Column:
    """The 64-bit FNV-1a hash of binary data in hexadecimal: a fold over bytes on two 32-bit halves."""
    low = (1 << 32) - 1
    pairs = F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(a: Column, pair: Column) -> Column:
        x = a["lo"].bitwiseXOR(F.conv(pair, 16, 10).cast("long"))
        product = x * 0x1B3  # the prime is 2^40 + 0x1b3
        hi = (a["hi"] * 0x1B3 + F.shiftright(product, 32) + x * 256).bitwiseAND(F.lit(low).cast("long"))
        return F.struct(hi.alias("hi"), product.bitwiseAND(F.lit(low).cast("long")).alias("lo"))

    return F.aggregate(pairs, start, step, lambda a: F.lower(F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0"))))
