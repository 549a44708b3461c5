"""Detectors: each gives the spans it finds in a text as an array, row by row, without a shuffle.

A detector works on a shadow (see functions.shadow) and returns spans in offsets of the text, in the order in which it
found them. Cheap tests keep texts that can hold no match away from the patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import is_mynumber, legal_pattern
from ..functions.scan import any_of, between, literal, matches, none, quoted, span, spans, starts
from ..functions.shadow import HYPHEN_CLASS, to_text

EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9\-])"
_H = "[" + "".join(quoted(c) for c in K.PHONE_HYPHENS) + "]"
_D, _BEFORE, _AFTER = r"\p{Nd}", r"(?<!\p{Nd})", r"(?!\p{Nd})"
PHONES = (
    f"{_BEFORE}0[36]{_H}{_D}{{4}}{_H}{_D}{{4}}{_AFTER}",
    f"{_BEFORE}0{_D}{{2,4}}{_H}{_D}{{1,4}}{_H}{_D}{{3,4}}{_AFTER}",
    f"{_BEFORE}0{_D}{{9,10}}{_AFTER}",
)
TWELVE = f"{_BEFORE}{_D}{{12}}{_AFTER}"
POSTAL = f"〒[{K.SPACE}]?{_D}{{3}}{HYPHEN_CLASS}{_D}{{4}}"
_PREFECTURE = any_of(K.PREFECTURES)
_BODY = f"[一-龥ァ-ヶ0-9{HYPHEN_CLASS[1:-1]}]"


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def in_text(found: Column, x: Column) -> Column:
    """Spans of a shadow in offsets of the text."""

    def back(s):
        first, last = to_text(x, s["start"], s["end"])
        return span(first, last, s["type"], s["score"], s["sources"])

    return F.when(F.size(x) == 0, found).otherwise(F.transform(found, back))


# ---- regular expressions ----------------------------------------------------------------------------------------


def email_ranges(s: Column) -> Column:
    return matches(s, EMAIL, gate=F.contains(s, F.lit("@")))


def phone_ranges(s: Column) -> list[Column]:
    gate = _has(s, f"0{_D}{{2}}|0[36]{_H}")
    return [matches(s, p, gate=gate) for p in PHONES]


def mynumber_ranges(s: Column) -> Column:
    found = matches(s, TWELVE, gate=_has(s, f"{_D}{{12}}"))
    return F.filter(found, lambda r: is_mynumber(between(s, r["s"], r["e"])))


def extra_patterns(items: Iterable[Mapping]) -> list[tuple[str, str]]:
    """(pattern, type) of configured items; those without a pattern or of no known type are left out."""
    return [(java_pattern(i["pattern"]), i["type"]) for i in items if i.get("pattern") and i.get("type") in K.TYPES]


def java_pattern(pattern: str) -> str:
    """A pattern as Java writes it: named groups of Python's dialect are rewritten, underscores in their names left out. A
    conditional group, for which Java has no form, is an error as the settings are read."""
    if re.search(r"\(\?\(", pattern):
        raise ValueError("a configured pattern holds a conditional group, which isn't supported")
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', '')}>", pattern)


def regex_spans(s: Column, extra: Iterable[tuple[str, str]] = (), types: Iterable[str] = K.TYPES) -> Column:
    """E-mail addresses, telephone numbers, personal numbers, then configured patterns; of the types that are wanted."""
    makers = ((K.EMAIL, lambda: [email_ranges(s)]), (K.PHONE, lambda: phone_ranges(s)), (K.MYNUMBER, lambda: [mynumber_ranges(s)]), *((t, lambda p=p: [matches(s, p)]) for p, t in extra))
    found = [spans(r, t, 1.0, "regex") for t, made in makers if t in types for r in made()]
    return F.concat(none(K.SPANS), *found)


# ---- structure -----------------------------------------------------------------------------------------------------


def org_prefix_ranges(s: Column, most: int = K.ORG_MAX) -> Column:
    return matches(s, f"{legal_pattern()}[{K.ORG_CHARS}]{{1,{most}}}", gate=_has(s, legal_pattern()))


def org_suffix_ranges(s: Column, most: int = K.ORG_MAX) -> Column:
    return matches(s, f"(?<![{K.ORG_CHARS}])[{K.ORG_CHARS}]{{1,{most}}}{legal_pattern()}", gate=_has(s, legal_pattern()))


def org_honorific_ranges(s: Column, most: int = K.ORG_MAX) -> Column:
    return matches(s, f"(?<![{K.ORG_CHARS}])[{K.ORG_CHARS}]{{1,{most}}}", any_of(K.ORG_HONORIFICS), gate=F.contains(s, F.lit(K.ORG_HONORIFICS[0])))


def person_ranges(s: Column, most: int = K.PERSON_MAX, stopwords: Iterable[str] = K.PERSON_STOPWORDS) -> Column:
    """Names before an honorific. What comes up to the last department character is cut off; general words and
    stopwords, and names of which nothing is left, are no names."""
    honorific = any_of(K.PERSON_HONORIFICS)
    found = matches(s, f"[{K.PERSON_CHARS}]{{1,{most}}}", honorific, gate=_has(s, honorific))

    def cut(r):
        name = F.regexp_extract(between(s, r["s"], r["e"]), f"[^{K.DEPARTMENT_ENDS}]*$", 0)
        return F.struct((r["e"] - F.length(name)).alias("s"), r["e"].alias("e"))

    stop = sorted({*(stopwords or K.PERSON_STOPWORDS), *K.GENERAL_STOPWORDS})
    return F.filter(F.transform(found, cut), lambda r: (r["s"] < r["e"]) & ~between(s, r["s"], r["e"]).isin(*stop))


def structural_spans(s: Column, person_max: int = K.PERSON_MAX, org_max: int = K.ORG_MAX, stopwords: Iterable[str] = K.PERSON_STOPWORDS) -> Column:
    return F.concat(
        spans(org_prefix_ranges(s, org_max), K.ORGANIZATION, 1.0, "structural"),
        spans(org_suffix_ranges(s, org_max), K.ORGANIZATION, 1.0, "structural"),
        spans(org_honorific_ranges(s, org_max), K.ORGANIZATION, 0.9, "structural"),
        spans(person_ranges(s, person_max, stopwords), K.PERSON, 0.9, "structural"),
    )


# ---- addresses -----------------------------------------------------------------------------------------------------


def postal_ranges(s: Column) -> Column:
    return matches(s, POSTAL, gate=F.contains(s, F.lit("〒")))


def address_ranges(s: Column) -> Column:
    """A prefecture and what follows it, if that holds a digit, or the mark of a city beyond its first character."""
    found = matches(s, f"{_PREFECTURE}{_BODY}{{1,40}}", gate=_has(s, _PREFECTURE))

    def real(r):
        body = F.regexp_replace(between(s, r["s"], r["e"]), f"^{_PREFECTURE}", "")
        return _has(body, f"[0-9]|.[{K.CITY_MARKS}]")

    return F.filter(found, real)


def address_spans(s: Column) -> Column:
    return F.concat(spans(postal_ranges(s), K.ADDRESS, 1.0, "address"), spans(address_ranges(s), K.ADDRESS, 1.0, "address"))


# ---- dictionary ----------------------------------------------------------------------------------------------------


def key_pattern(key: str) -> str:
    """A pattern for a folded key in a shadow that isn't folded: white space may stand between its characters, and any
    hyphen for a hyphen."""
    return f"[{K.SPACE}]*".join(HYPHEN_CLASS if c == "-" else quoted(c) for c in key)


def dictionary_spans(s: Column, keys: list[tuple[str, str]], fold: Column) -> Column:
    """All occurrences of keys (folded key, type), overlapping and nested ones too, wherever they stand in a word, in the
    order of their ends, the longest first. A key is looked for by pattern only where the folded shadow contains it; `fold`, that shadow, should be a column, as each key looks at it.

    The keys travel in the plan as one literal; see sources.dictionary for how large it may be."""
    if not keys:
        return none(K.SPANS)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.lit(key_pattern(k)).alias("pattern")) for k, t in keys])
    present = F.filter(entries, lambda k: F.contains(fold, k["key"]))

    def occurrences(k):
        def one(at):
            rest = F.substring(s, at + 1, F.length(s))
            size = F.length(F.call_function("regexp_extract", rest, F.concat(F.lit("^("), k["pattern"], F.lit(")")), F.lit(1)))
            return F.struct((at + size).alias("end"), at.alias("start"), k["type"].alias("type"))

        return F.transform(starts(s, k["pattern"]), one)

    found = F.array_sort(F.flatten(F.transform(present, occurrences)))
    made = F.transform(found, lambda o: span(o["start"], o["end"], o["type"], F.lit(1.0), F.array(F.lit("denylist"))))
    return F.when(F.size(present) > 0, made).otherwise(none(K.SPANS))


# ---- known entities (for evaluation and tests) ----------------------------------------------------------------------


def gold_spans(text: Column, entities: Column) -> Column:
    """Spans of entities array<struct<surface, type, nth>> in a text: the longest first, all occurrences or the nth (from
    0); an occurrence that touches an earlier one is left out."""
    named = F.filter(entities, lambda e: F.length(e["surface"]) > 0)
    ordered = F.array_sort(F.transform(named, lambda e, i: F.struct((-F.length(e["surface"])).alias("k"), i.alias("i"), e["surface"].alias("surface"), e["type"].alias("type"), e["nth"].alias("nth"))))

    def places(e):
        every = starts(text, literal(e["surface"]))
        return F.when(e["nth"].isNull(), every).when((e["nth"] >= 0) & (e["nth"] < F.size(every)), F.slice(every, e["nth"] + 1, 1)).otherwise(none("array<int>"))

    def take(acc, e):
        size = F.length(e["surface"])
        return F.aggregate(
            places(e),
            acc,
            lambda a, at: F.when(F.exists(a, lambda x: (x["start"] < at + size) & (at < x["end"])), a).otherwise(
                F.concat(a, F.array(span(at, at + size, e["type"], F.lit(1.0), F.array(F.lit("stub")))))
            ),
        )

    return F.array_sort(F.aggregate(ordered, none(K.SPANS), take))
