"""Masking: spans become numbered placeholders that can be turned back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import label, padded, placeholder
from ..functions.scan import any_of, between, held, none

_LABEL = any_of(K.LABELS.values())
#: A placeholder of a known label as a careless writer may leave it: one or two brackets of either kind, spaces, digits
#: of either width.
LOOSE = f"[\\[【]{{1,2}}[{K.SPACE}]*({_LABEL})[{K.SPACE}]*_?[{K.SPACE}]*([0-9０-９]+)[{K.SPACE}]*[\\]】]{{1,2}}"
_USED = "array<struct<label:string,n:int>>"
_ORDERED = "array<struct<start:int,end:int,i:int,type:string,sources:array<string>>>"


def ordered(found: Column) -> Column:
    """Spans by place, without repeats of range and type. Overlapping ones are an error, whose message holds no text."""
    keyed = F.array_sort(F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"), s["type"].alias("type"), s["sources"].alias("sources"))))
    same = lambda a, s: F.exists(a, lambda x: (x["start"] == s["start"]) & (x["end"] == s["end"]) & (x["type"] == s["type"]))
    unique = F.aggregate(keyed, none(_ORDERED), lambda a, s: F.when(same(a, s), a).otherwise(F.concat(a, F.array(s))))
    return unique


def overlapping(spans: Column) -> Column:
    """Whether two neighbours of ordered spans overlap."""
    n = F.size(spans)
    return F.exists(F.zip_with(F.slice(spans, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(spans, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b["start"] < a["end"]), lambda x: x)


def used_numbers(text: Column) -> Column:
    """Numbers of placeholders that the text holds already, with their labels."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(LOOSE), F.lit(0)),
        lambda f: F.struct(F.regexp_extract(f, LOOSE, 1).alias("label"), F.translate(F.regexp_extract(f, LOOSE, 2), "０１２３４５６７８９", "0123456789").alias("d")),
    )
    real = F.filter(found, lambda f: F.regexp_like(f["d"], F.lit("^[1-9][0-9]{0,8}$")))
    numbers = F.transform(real, lambda f: F.struct(f["label"].alias("label"), f["d"].cast("int").alias("n")))
    return F.when(F.regexp_like(text, F.lit(r"[\[【]")), numbers.cast(_USED)).otherwise(none(_USED))


def nth_free(k: Column, used: Column) -> Column:
    """The k-th of 1, 2, 3, ... that isn't used."""
    return F.element_at(F.array_except(F.sequence(F.lit(1), k + F.size(used)), used), k)


_FIRSTS = "array<struct<type:string,surface:string,sources:array<string>>>"


def mask(df: DataFrame, text: str = "text", found: str = "spans") -> DataFrame:
    """df with masked_text, mapping (placeholder to surface) and report, one item for each type and surface by its first
    occurrence. Numbers count from 1 for each type and skip those that the text holds already. Row by row, no shuffle."""
    t = F.col(text)
    df = df.withColumn("_spans", held(ordered(F.col(found))))
    fail = F.raise_error(F.lit("overlapping spans can't be masked; merge them first")).cast(_ORDERED)
    df = df.withColumn("_spans", held(F.when(overlapping(F.col("_spans")), fail).otherwise(F.col("_spans"))))
    new = lambda s: F.struct(s["type"].alias("type"), between(t, s["start"], s["end"]).alias("surface"), s["sources"].alias("sources"))
    seen = lambda a, c: F.exists(a, lambda x: (x["type"] == c["type"]) & (x["surface"] == c["surface"]))
    each = F.transform(F.col("_spans"), new)
    firsts = F.aggregate(each, none(_FIRSTS), lambda a, c: F.when(seen(a, c), a).otherwise(F.concat(a, F.array(c))))
    df = df.withColumn("_firsts", held(firsts)).withColumn("_used", held(F.when(F.size("_spans") > 0, used_numbers(t)).otherwise(none(_USED))))

    def item(f, i):
        k = F.size(F.filter(F.slice(F.col("_firsts"), F.lit(1), i + 1), lambda g: g["type"] == f["type"]))
        used = F.array_distinct(F.transform(F.filter(F.col("_used"), lambda u: u["label"] == label(f["type"])), lambda u: u["n"]))
        return F.struct(f["surface"].alias("original"), placeholder(f["type"], nth_free(k, used)).alias("token"), f["type"].alias("type"), f["sources"].alias("sources"))

    df = df.withColumn("report", held(F.transform(F.col("_firsts"), item)))

    def put(a, s):
        here = between(t, s["start"], s["end"])
        token = F.element_at(F.filter(F.col("report"), lambda r: (r["type"] == s["type"]) & (r["original"] == here)), 1)["token"]
        return F.struct(F.concat(a["out"], between(t, a["at"], s["start"]), token).alias("out"), s["end"].alias("at"))

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(F.col("_spans"), zero, put, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    df = df.withColumn("masked_text", held(F.when(F.size("_spans") > 0, masked).otherwise(t)))
    df = df.withColumn("mapping", F.map_from_arrays(F.transform("report", lambda r: r["token"]), F.transform("report", lambda r: r["original"])))
    return df.drop("_spans", "_firsts", "_used")


def mapping_rows(masked: DataFrame, *keys: str) -> DataFrame:
    """(keys, ord, token, original, type, sources): the mapping as a table, in the order of first occurrence."""
    keys = keys or ("doc_id",)
    return masked.select(*keys, F.posexplode("report").alias("ord", "_r")).select(*keys, "ord", "_r.token", "_r.original", "_r.type", "_r.sources")


def report_text(report: Column) -> Column:
    """The report for a reader: a headline, a line for each item, and a reminder."""
    line = lambda r: F.concat(
        F.lit("  "), padded(r["token"], 12), F.lit("  "), padded(label(r["type"]), 6), F.lit("  "), r["original"], F.lit("   <- "),
        F.when(F.size(r["sources"]) > 0, F.array_join(r["sources"], ",")).otherwise(F.lit("-")),
    )
    head = F.concat(F.lit("=== マスク結果: "), F.size(report).cast("string"), F.lit(" 件 ==="))
    return F.concat_ws("\n", head, F.transform(report, line), F.lit("※ 外部AIへ送る前に、上記の検出内容を必ずレビューしてください。"))
