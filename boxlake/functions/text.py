"""Text expressions: normalisation, similarity, pattern tags, relevance, sort key."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class TextPattern(NamedTuple):
    pattern: str
    regex: str
    priority: int
    description: str


# Names, expressions, priorities and descriptions of the default address
# patterns; names, priorities and descriptions also appear in written documents.
DEFAULT_PATTERNS = (
    TextPattern("input", r"I\d+\.\d+", 10, "Input addresses (I0.1, I1.2, etc.)"),
    TextPattern("output", r"Q\d+\.\d+", 10, "Output addresses (Q0.1, Q2.3, etc.)"),
    TextPattern("memory", r"M\d+\.\d+", 9, "Memory addresses (M0.1, M1.2, etc.)"),
    TextPattern("timer", r"T\d+", 8, "Timer addresses (T1, T2, etc.)"),
    TextPattern("counter", r"C\d+", 8, "Counter addresses (C1, C2, etc.)"),
    TextPattern("function_block", r"FB\d+", 7, "Function blocks (FB1, FB2, etc.)"),
    TextPattern("data_block", r"DB\d+", 7, "Data blocks (DB1, DB2, etc.)"),
    TextPattern("analog_input", r"AI\d+", 6, "Analog inputs (AI1, AI2, etc.)"),
    TextPattern("analog_output", r"AO\d+", 6, "Analog outputs (AO1, AO2, etc.)"),
    TextPattern("variable", r"[A-Z][A-Z0-9_]{2,}", 5, "Variable names"),
    TextPattern("numeric", r"\d+\.?\d*", 3, "Numeric values"),
    TextPattern("label", r"[A-Za-z][A-Za-z0-9_]{1,}", 2, "General labels"),
)


# The characters of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove white space on both ends, Unicode-aware."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def normalised(text: Column) -> Column:
    """Lower case without anything but word characters."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]", "")


def similar(a: Column, b: Column, strict_ratio: float | None = None) -> Column:
    """Whether two *normalised* texts are equal or one contains the other. With
    `strict_ratio` the shorter one must also have that share of the longer one."""
    filled = (F.length(a) > 0) & (F.length(b) > 0)
    contains = F.contains(a, b) | F.contains(b, a)
    if strict_ratio is not None:
        shorter = F.least(F.length(a), F.length(b))
        longer = F.greatest(F.length(a), F.length(b))
        contains = contains & ((a == b) | (F.try_divide(shorter, longer) > strict_ratio))
    return filled & contains


def matched_patterns(text: Column, patterns: Sequence[TextPattern] = DEFAULT_PATTERNS) -> Column:
    """All patterns found anywhere in the text, in declared order, ignoring case."""
    hits = [
        F.when(
            F.rlike(text, F.lit("(?iU)" + p.regex)),
            F.struct(
                F.lit(p.pattern).alias("pattern"),
                F.lit(p.priority).alias("priority"),
                F.lit(p.description).alias("description"),
            ),
        )
        for p in patterns
    ]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def relevance(text: Column, patterns: Column) -> Column:
    """1, plus the priorities found, plus up to 2 for length, plus 1 for a digit."""
    bonus = F.aggregate(patterns, F.lit(0), lambda total, p: total + p["priority"])
    length = F.least(F.lit(2.0), F.length(text) / F.lit(5.0))
    digit = F.when(F.rlike(text, F.lit(r"(?U)\d")), 1.0).otherwise(0.0)
    return F.round(F.lit(1.0) + bonus + length + digit, 2)


def alphanumeric_key(text: Column, x: Column, y: Column) -> Column:
    """Array that sorts like: runs of digits by number, before letters; then position.

    Numbers compare by length of the digits without leading zeros and then by the
    digits, which is exact for any number of digits.
    """
    runs = F.regexp_extract_all(F.upper(text), F.lit(r"(?U)([A-Z]+|\d+)"), 1)

    def part(rank, n, s, px, py):
        return F.struct(
            rank.alias("rank"), n.alias("n"), s.alias("s"), px.alias("x"), py.alias("y")
        )

    zero, x, y = F.lit(0.0), x.cast("double"), y.cast("double")

    def run(r):
        digits = F.regexp_replace(r, "^0+", "")
        is_number = F.rlike(r, F.lit(r"(?U)^\d"))
        return part(
            F.when(is_number, 0).otherwise(1),
            F.when(is_number, F.length(digits)).otherwise(0),
            F.when(is_number, digits).otherwise(r),
            zero,
            zero,
        )

    last = part(F.lit(2), F.lit(0), F.lit(""), x, y)
    return F.concat(F.transform(runs, run), F.array(last))


def alphanumeric_order(text: Column, x: Column, y: Column) -> list[Column]:
    """Columns that sort like `alphanumeric_key`, as a plain string and the position: cheaper
    to make, to shuffle and to compare than an array."""
    runs = F.regexp_extract_all(F.upper(text), F.lit(r"(?U)([A-Z]+|\d+)"), 1)

    def run(r):
        digits = F.ltrim(r, F.lit("0"))
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(F.substring(r, 1, 1).between("A", "Z"), F.concat(F.lit("1"), r)).otherwise(number)

    # marks are lower than letters, so that a run comes before those it begins
    key = F.concat(F.array_join(F.transform(runs, run), ""), F.lit("2"))
    known = text.isNotNull()
    return [key, F.when(known, x.cast("double")), F.when(known, y.cast("double"))]


def padded(value: Column) -> Column:
    """At least three digits; longer numbers stay whole."""
    digits = value.cast("string")
    usual = F.when(value.between(0, 999), F.lpad(digits, 3, "0")).when(value > 999, digits)
    return usual.otherwise(F.format_string("%03d", value))
