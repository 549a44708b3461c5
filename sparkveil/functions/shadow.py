"""Shadows of a text: each character in compatibility form (NFKC), with the way back to the text's offsets.

Characters are mapped one by one, so that sequences aren't composed. Most characters map to one, and offsets stay. For
the others only the places are kept: x is an array of (o, p, n), the character's offset in the text, the offset of what
it becomes in the shadow, and the length of that. Its size follows the number of such characters, not the text."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import HYPHENS, SPACE
from .scan import CLOSE, OPEN, clean, none

PLACES = "array<struct<o:int,p:int,n:int>>"


@cache
def compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that NFKC maps to one other character, and those that it maps to several."""
    one, many = {}, {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        if (to := unicodedata.normalize("NFKC", ch)) != ch:
            (one if len(to) == 1 else many)[ch] = to
    return one, many


@cache
def digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and the ASCII digit of each."""
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *digits())


@cache
def _many_class() -> str:
    """A character class of what NFKC maps to several; common characters are ruled out first."""
    codes = sorted(map(ord, compatibility()[1]))
    ranges, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        ranges.append(f"\\x{{{codes[i]:X}}}-\\x{{{codes[j]:X}}}")
        i = j + 1
    return r"(?![\x00-\x7Fぁ-ゖァ-ヺ一-鿿])[" + "".join(ranges) + "]"


def single(text: Column) -> Column:
    """NFKC of the characters that become one."""
    one, _ = compatibility()
    return F.translate(text, "".join(one), "".join(one.values()))


def shadow(text: Column) -> Column:
    """struct<s: the shadow, x: its places>."""
    _, many = compatibility()
    several = F.length(F.translate(text, "".join(many), "")) < F.length(text)
    ascii_only = ~F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    pieces = F.split(F.regexp_replace(clean(text), f"({_many_class()})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")
    to = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    zero = F.struct(F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit(False).alias("odd"), F.lit("").alias("s"), none(PLACES).alias("x"))

    def step(a, piece):
        new = F.when(a["odd"], F.coalesce(F.element_at(to, piece), piece)).otherwise(single(piece))
        n = F.length(new)
        place = F.array(F.struct(a["o"].alias("o"), a["p"].alias("p"), n.alias("n")))
        return F.struct(
            (a["o"] + F.length(piece)).alias("o"),
            (a["p"] + n).alias("p"),
            (~a["odd"]).alias("odd"),
            F.concat(a["s"], new).alias("s"),
            F.when(a["odd"], F.concat(a["x"], place)).otherwise(a["x"]).alias("x"),
        )

    whole = F.aggregate(pieces, zero, step, lambda a: F.struct(a["s"].alias("s"), a["x"].alias("x")))
    plain = F.struct(F.when(ascii_only, text).otherwise(single(text)).alias("s"), none(PLACES).alias("x"))
    return F.when(~ascii_only & several, whole).otherwise(plain)


def _back(x: Column, at: Column) -> Column:
    less = F.aggregate(x, F.lit(0), lambda a, c: a + F.when(c["p"] + c["n"] <= at, c["n"] - 1).when(c["p"] < at, at - c["p"]).otherwise(0))
    return at - less


def to_text(x: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Offsets in the text of a range of the shadow; a character that it touches is taken whole."""
    return _back(x, start), _back(x, end - 1) + 1


def to_shadow(x: Column, at: Column) -> Column:
    """Offset in the shadow of a character of the text, or of its end."""
    return at + F.aggregate(x, F.lit(0), lambda a, c: a + F.when(c["o"] < at, c["n"] - 1).otherwise(0))


def checked_to_text(s: Column, x: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """to_text that fails on a range that is empty or beyond the shadow. The message holds no text."""
    bad = (start < 0) | (end > F.length(s)) | (end <= start)
    first, last = to_text(x, start, end)
    fail = F.raise_error(F.lit("a range of the shadow is empty or out of bounds")).cast("int")
    return F.when(bad, fail).otherwise(first), F.when(bad, fail).otherwise(last)


# ---- without white space and with one hyphen, for the dictionary -------------------------------------------------

HYPHEN_CLASS = "[" + "".join(re.escape(c) if c == "-" else c for c in HYPHENS) + "]"


def folded(s: Column) -> Column:
    """A shadow without white space, all hyphens as one."""
    return F.regexp_replace(F.translate(s, HYPHENS, "-" * len(HYPHENS)), f"[{SPACE}]+", "")


def fold_python(text: str) -> str:
    """The same of a dictionary entry, on the driver."""
    both = "".join(unicodedata.normalize("NFKC", c) for c in text)
    return "".join("-" if c in HYPHENS else c for c in both if not c.isspace())


def places(text: Column) -> Column:
    """The places of a text's shadow without the shadow: only characters that become several are looked up."""
    _, many = compatibility()
    several = F.length(F.translate(text, "".join(many), "")) < F.length(text)
    pieces = F.split(F.regexp_replace(clean(text), f"({_many_class()})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]")
    to = F.from_json(F.lit(json.dumps({c: len(n) for c, n in many.items()})), "map<string,int>")
    zero = F.struct(F.lit(0).alias("o"), F.lit(0).alias("p"), F.lit(False).alias("odd"), none(PLACES).alias("x"))

    def step(a, piece):
        n = F.when(a["odd"], F.element_at(to, piece)).otherwise(F.length(piece))
        place = F.array(F.struct(a["o"].alias("o"), a["p"].alias("p"), n.alias("n")))
        return F.struct((a["o"] + F.length(piece)).alias("o"), (a["p"] + n).alias("p"), (~a["odd"]).alias("odd"), F.when(a["odd"], F.concat(a["x"], place)).otherwise(a["x"]).alias("x"))

    return F.when(several, F.aggregate(pieces, zero, step, lambda a: a["x"])).otherwise(none(PLACES))


def sources(text: Column, x: Column) -> Column:
    """The source offset of each character of the shadow, from its places x: runs of characters that stay one, and between
    them a character's offset as often as it became characters."""
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none("array<int>"))
    zero = F.struct(F.lit(0).alias("o"), none("array<int>").alias("out"))
    step = lambda a, c: F.struct((c["o"] + 1).alias("o"), F.concat(a["out"], run(a["o"], c["o"]), F.array_repeat(c["o"], c["n"])).alias("out"))
    odd = F.aggregate(x, zero, step, lambda a: F.concat(a["out"], run(a["o"], F.length(text))))
    return F.when(F.size(x) == 0, run(F.lit(0), F.length(text))).otherwise(odd)


def charmap(text: Column, fold: bool = False) -> Column:
    """struct<s, charmap>: the shadow with the source offset of each of its characters, looked up one by one. For short
    texts and tests; the operators use places, which don't grow with the text."""
    one, many = compatibility()
    to = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    chars = F.when(text == "", none("array<string>")).otherwise(F.split(text, ""))
    each = F.transform(chars, lambda c: F.coalesce(F.element_at(to, c), single(c)))
    pairs = F.flatten(F.transform(each, lambda c, i: F.transform(F.split(c, ""), lambda k: F.struct(k.alias("c"), i.cast("int").alias("i")))))
    if fold:
        pairs = F.filter(pairs, lambda p: ~F.regexp_like(p["c"], F.lit(f"^[{SPACE}]$")))
        pairs = F.transform(pairs, lambda p: F.struct(F.translate(p["c"], HYPHENS, "-" * len(HYPHENS)).alias("c"), p["i"].alias("i")))
    return F.struct(F.array_join(F.transform(pairs, lambda p: p["c"]), "").alias("s"), F.transform(pairs, lambda p: p["i"]).alias("charmap"))
