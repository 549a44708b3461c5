"""Where patterns and literals occur in a text, as columns: no Python runs on the executors and nothing is shuffled.

Offsets count code points. A pattern's matches are put between two private-use characters, the text is split at these,
and a running sum of the pieces' lengths gives the offsets. A text that holds these characters itself is scanned in a
copy in which they are others of the same length."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""
RANGES = "array<struct<s:int,e:int>>"


def quoted(text: str) -> str:
    """A literal for a Java pattern."""
    return re.sub(r"([^\w\s]|[\\^$.|?*+()\[\]{}&-])", lambda m: m[0] if ord(m[0]) > 127 else "\\" + m[0], text)


def any_of(words) -> str:
    """An alternation, the longest first."""
    return "(?:" + "|".join(quoted(w) for w in sorted(words, key=len, reverse=True)) + ")"


def none(kind: str) -> Column:
    return F.array().cast(kind)


def held(made: Column) -> Column:
    """A value that the optimizer keeps in its own projection. Deterministic expressions are copied into every filter
    and projection above that uses them; these chains are so long that copies of copies would outgrow the planner, and
    texts would be scanned once for each copy."""
    return F.when(F.spark_partition_id() >= 0, made)


def clean(text: Column) -> Column:
    """The copy to scan."""
    return F.translate(text, OPEN + CLOSE, "")


def matches(text: Column, pattern: str, then: str = "", gate: Column | None = None) -> Column:
    """Ranges (s, e) of the leftmost, greedy, non-overlapping matches of `pattern` followed by `then`; the range is that
    of `pattern`, which may hold groups of its own. gate: a cheap test that is false only where there is no match."""
    if then:  # groups by name, as those of the pattern shift numbers
        marked = F.regexp_replace(clean(text), f"(?<svWhole>{pattern})(?<svThen>{then})", f"{OPEN}${{svWhole}}{CLOSE}${{svThen}}")
    else:
        marked = F.regexp_replace(clean(text), pattern, f"{OPEN}$0{CLOSE}")
    found = _odd_pieces(F.split(marked, f"[{OPEN}{CLOSE}]"))
    return F.coalesce(F.when(gate, found).otherwise(none(RANGES)) if gate is not None else found, none(RANGES))


def _odd_pieces(pieces: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none(RANGES).alias("out"))

    def step(a, piece):
        end = a["at"] + F.length(piece)
        here = F.array(F.struct(a["at"].alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), (~a["odd"]).alias("odd"), F.when(a["odd"] & (end > a["at"]), F.concat(a["out"], here)).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def starts(text: Column, pattern: Column) -> Column:
    """Offsets at which a pattern matches, overlapping ones too, in one pass: the text is split before each of them."""
    pieces = F.split(text, F.concat(F.lit("(?="), pattern, F.lit(")")))
    zero = F.struct(F.lit(0).alias("at"), none("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    all_pieces = F.aggregate(pieces, zero, step, lambda a: a["out"])
    first = F.regexp_like(text, F.concat(F.lit("^(?:"), pattern, F.lit(")")))
    return F.when(text == "", none("array<int>")).when(first, all_pieces).otherwise(F.slice(all_pieces, F.lit(2), F.greatest(F.size(all_pieces) - 1, F.lit(0))))


def literal(text: Column) -> Column:
    """A column's text as a literal for a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def spans(ranges: Column, kind: str, score: float, source: str) -> Column:
    """Spans of one type from ranges."""
    return F.transform(ranges, lambda r: span(r["s"], r["e"], F.lit(kind), F.lit(score), F.array(F.lit(source))))


def span(start: Column, end: Column, kind: Column, score: Column, sources: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("type"), score.cast("double").alias("score"), sources.alias("sources"))
