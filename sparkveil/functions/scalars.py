"""Scalar functions on names, numbers, placeholders and model answers, as columns."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .scan import any_of, between, none
from .shadow import ascii_digits


def legal_form(name: Column) -> Column:
    """struct<form, core>: the first legal form, in the list's order, that the name begins or else ends with, and the
    rest; null and the name itself if there is none. One form is taken off."""
    out = F.struct(F.lit(None).cast("string").alias("form"), name.alias("core"))
    for f in reversed(K.LEGAL_FORMS):
        rest = F.length(name) - len(f)
        front = F.struct(F.lit(f).alias("form"), F.substring(name, F.lit(len(f) + 1), rest).alias("core"))
        back = F.struct(F.lit(f).alias("form"), F.substring(name, F.lit(1), rest).alias("core"))
        out = F.when(F.startswith(name, F.lit(f)), front).when(F.endswith(name, F.lit(f)), back).otherwise(out)
    return out


def check_digit(first11: Column) -> Column:
    """The twelfth digit that eleven digits ask for."""
    weighed = reduce(lambda a, b: a + b, (F.substring(first11, 11 - i, 1).cast("int") * w for i, w in enumerate(K.CHECK_WEIGHTS)))
    rest = F.pmod(weighed, F.lit(11))
    return F.when(rest <= 1, F.lit(0)).otherwise(11 - rest)


def is_mynumber(text: Column) -> Column:
    """Whether a text is twelve digits of which the last is right; a gate keeps other texts from the arithmetic."""
    plain = ascii_digits(text)
    return F.when(F.regexp_like(plain, F.lit("^[0-9]{12}$")), check_digit(F.substring(plain, 1, 11)) == F.substring(plain, 12, 1).cast("int")).otherwise(F.lit(False))


def _by_type(kind: Column, values: dict[str, str]) -> Column:
    return reduce(lambda a, kv: F.when(kind == kv[0], F.lit(kv[1])).otherwise(a), reversed(list(values.items())), kind)


def label(kind: Column) -> Column:
    """The label of a type; an unknown type is its own label."""
    return _by_type(kind, K.LABELS)


def placeholder(kind: Column, index: Column) -> Column:
    return F.concat(F.lit("[["), label(kind), F.lit("_"), index.cast("string"), F.lit("]]"))


CANONICAL = r"(?s)^\[\[(.+?)_(\p{Nd}+)\]\]\n?$"


def parse_token(token: Column) -> Column:
    """struct<label, index> of a canonical placeholder; anything else is an error, whose message holds no text."""
    good = F.regexp_like(token, F.lit(CANONICAL))
    parts = F.struct(F.regexp_extract(token, CANONICAL, 1).alias("label"), number(F.regexp_extract(token, CANONICAL, 2)).alias("index"))
    return F.when(good, parts).otherwise(F.struct(F.raise_error(F.lit("not a canonical placeholder")).cast("string").alias("label"), F.lit(None).cast("string").alias("index")))


def number(digits: Column) -> Column:
    """Digits of any script as a plain number without leading zeros, as text: it may be longer than any integer type."""
    return F.regexp_replace(ascii_digits(digits), "^0+(?=[0-9])", "")


def index_pattern(index: Column) -> Column:
    """A pattern for a number, each digit in half or full width."""
    return F.array_join(F.transform(F.split(index.cast("string"), ""), lambda d: F.concat(F.lit("["), d, F.translate(d, "0123456789", "０１２３４５６７８９"), F.lit("]"))), "")


def ner_type(name: Column) -> Column:
    """The type of a recogniser's label, or null."""
    return reduce(lambda a, kv: F.when(name.isin(*kv[1]), F.lit(kv[0])).otherwise(a), K.NER_LABELS.items(), F.lit(None).cast("string"))


def model_type(raw: Column) -> Column:
    """The type a language model's word for it stands for: a person, or else an organisation."""
    person = F.upper(raw).contains("PERSON") | raw.contains("人物") | raw.contains("人名")
    return F.when(F.coalesce(person, F.lit(False)), F.lit(K.PERSON)).otherwise(F.lit(K.ORGANIZATION))


def trimmed(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A range without the white space at its ends; empty if it is all white space."""
    surface = between(text, start, end)
    left = F.length(surface) - F.length(F.regexp_replace(surface, f"^[{K.SPACE}]+", ""))
    right = F.length(surface) - F.length(F.regexp_replace(surface, f"[{K.SPACE}]+$", ""))
    blank = left == F.length(surface)
    return F.when(blank, end).otherwise(start + left), F.when(blank, end).otherwise(end - right)


def chunks(text: Column, size: int = 700) -> Column:
    """array<struct<chunk, offset>>: sentences, which end after 。！？ or a line, packed to at most `size` characters (200
    at the least); a longer sentence stays whole."""
    size = max(200, size)
    parts = F.split(text, "(?<=[。！？\n])")
    zero = F.struct(F.lit("").alias("cur"), F.lit(0).alias("start"), F.lit(0).alias("pos"), none("array<struct<chunk:string,offset:int>>").alias("out"))

    def step(a, p):
        full = (a["cur"] != "") & (F.length(a["cur"]) + F.length(p) > size)
        done = F.array(F.struct(a["cur"].alias("chunk"), a["start"].alias("offset")))
        return F.struct(
            F.when(full, p).otherwise(F.concat(a["cur"], p)).alias("cur"),
            F.when(full, a["pos"]).otherwise(a["start"]).alias("start"),
            (a["pos"] + F.length(p)).alias("pos"),
            F.when(full, F.concat(a["out"], done)).otherwise(a["out"]).alias("out"),
        )

    end = lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(F.struct(a["cur"].alias("chunk"), a["start"].alias("offset"))))).otherwise(a["out"])
    return F.aggregate(parts, zero, step, end)


ITEM = "struct<text:string,surface:string,type:string>"


def additions(answer: Column) -> Column:
    """array<struct<text, type>> of a model's answer: a JSON list, or the list under `additions` of an object; empty for
    anything else. Items that aren't objects or have no text are dropped; a number counts as its digits."""
    raw = "array<string>"  # items in JSON: one bad item doesn't spoil the others
    as_list = F.from_json(F.when(F.regexp_like(answer, F.lit(r"^\s*\[")), answer), raw)
    as_object = F.from_json(F.when(F.regexp_like(answer, F.lit(r"^\s*\{")), answer), f"struct<additions:{raw}>")["additions"]
    items = F.transform(F.coalesce(as_list, as_object, none(raw)), lambda i: F.from_json(F.when(F.regexp_like(i, F.lit(r"^\s*\{")), i), ITEM))
    strip = lambda c: F.regexp_replace(c, f"^[{K.SPACE}]+|[{K.SPACE}]+$", "")
    named = F.transform(items, lambda i: F.struct(strip(F.coalesce(F.when(i["text"] != "", i["text"]), i["surface"], F.lit(""))).alias("text"), i["type"].alias("type")))
    return F.filter(named, lambda i: i["text"] != "")


PROMPT = (
    "次の本文から、取引先・人物・案件を特定できる固有名詞のうち、まだマスクされていないものだけを挙げてください。\n"
    '答えは JSON のみ: {"additions":[{"text":"本文にある語","type":"PERSON|ORGANIZATION"}]}。\n'
    "本文に一字一句存在する語に限り、一般名詞・地名・日付・数値、既にマスク済みの語は含めないこと。無ければ空の配列。\n"
)


def prompt(chunk: Column, existing: Column) -> Column:
    """What a language model is asked about a chunk: names that aren't masked yet, as JSON. existing: array of surfaces."""
    known = F.to_json(F.array_sort(F.array_distinct(existing)))
    return F.concat(F.lit(PROMPT + "本文: 「"), chunk, F.lit("」\nマスク済み: "), known, F.lit("\n出力:"))


def is_loopback(url: str) -> bool:
    """Whether a URL names this machine: localhost or a loopback address. No name is looked up."""
    host = urlsplit(url).hostname or ""
    if host == "localhost":
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def padded(text: Column, width: int) -> Column:
    """At least `width` code points wide; never cut."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(text))))


def legal_pattern() -> str:
    return any_of(K.LEGAL_FORMS)

