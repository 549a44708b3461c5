"""Restoring: placeholders, also carelessly rewritten ones, become what they stood for; others are reported, never
guessed. All of it works within a row of a reply and its mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import index_pattern, number, parse_token
from ..functions.scan import held, literal, none

_S = f"[{K.SPACE}]*"
#: Anything that looks like a placeholder.
ANY = f"[\\[【]{{1,2}}{_S}([^\\[\\]【】_{K.SPACE}]+){_S}_?{_S}(\\p{{Nd}}+){_S}[\\]】]{{1,2}}"


def replacement(text: Column) -> Column:
    """A text as a literal replacement for a pattern."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def exact(text: Column, pairs: Column) -> Column:
    """Placeholders as they were made, the longest first."""
    ranked = F.array_sort(F.transform(pairs, lambda p, i: F.struct((-F.length(p["token"])).alias("k"), i.alias("i"), p["token"].alias("token"), p["original"].alias("original"))))
    return F.aggregate(ranked, text, lambda a, p: F.replace(a, p["token"], p["original"]))


def lenient(text: Column, parsed: Column) -> Column:
    """struct<text, warnings>: rewritten placeholders of known labels and numbers, the greatest number first."""
    key = lambda p: F.lpad(p["index"], 40, "0")
    ranked = F.reverse(F.array_sort(F.transform(parsed, lambda p, i: F.struct(key(p).alias("k"), (-i).alias("i"), p["token"].alias("token"), p["label"].alias("label"), p["index"].alias("index"), p["original"].alias("original")))))

    def step(a, p):
        pattern = F.concat(F.lit(f"[\\[【]{{1,2}}{_S}"), literal(p["label"]), F.lit(f"{_S}_?{_S}"), index_pattern(p["index"]), F.lit(f"{_S}[\\]】]{{1,2}}"))
        n = F.regexp_count(a["text"], pattern)
        note = F.concat(F.lit("改変されたプレースホルダを寛容照合で復元しました: "), p["token"], F.lit(" (×"), n.cast("string"), F.lit(")"))
        put = F.struct(F.regexp_replace(a["text"], pattern, replacement(p["original"])).alias("text"), F.concat(a["warnings"], F.array(note)).alias("warnings"))
        return F.when(n > 0, put).otherwise(a)

    zero = F.struct(text.alias("text"), none("array<string>").alias("warnings"))
    return F.when(F.regexp_like(text, F.lit(r"[\[【]")), F.aggregate(ranked, zero, step)).otherwise(zero)


def unresolved(text: Column, parsed: Column) -> Column:
    """What still looks like a placeholder and has no known label and number; each once, in order."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    known = lambda f: F.exists(parsed, lambda p: (p["label"] == F.regexp_extract(f, ANY, 1)) & (p["index"] == number(F.regexp_extract(f, ANY, 2))))
    return F.when(F.regexp_like(text, F.lit(r"[\[【]")), F.array_distinct(F.filter(found, lambda f: ~known(f)))).otherwise(none("array<string>"))


def unmask(df: DataFrame, text: str = "masked_text", mapping: str = "mapping", to: str = "restored") -> DataFrame:
    """df with `to`, warnings and unresolved. mapping: map of placeholder to original; a key that is no placeholder is an
    error. Originals are put in as they are, whatever they hold."""
    pair = lambda e: F.struct(e["key"].alias("token"), e["value"].alias("original"), parse_token(e["key"]).alias("p"))
    df = df.withColumn("_pairs", held(F.transform(F.map_entries(mapping), pair)))
    flat = lambda p: F.struct(p["token"].alias("token"), p["original"].alias("original"), p["p"]["label"].alias("label"), p["p"]["index"].alias("index"))
    df = df.withColumn("_parsed", held(F.transform("_pairs", flat)))
    df = df.withColumn("_exact", held(exact(F.col(text), F.col("_parsed"))))
    df = df.withColumn("_loose", held(lenient(F.col("_exact"), F.col("_parsed"))))
    df = df.withColumn(to, F.col("_loose.text")).withColumn("unresolved", held(unresolved(F.col("_loose.text"), F.col("_parsed"))))
    summary = F.concat(F.lit("mapping に対応の無い未解決プレースホルダが残っています（復元せず保持）: "), F.array_join("unresolved", ", "))
    df = df.withColumn("warnings", F.when(F.size("unresolved") > 0, F.concat(F.col("_loose.warnings"), F.array(summary))).otherwise(F.col("_loose.warnings")))
    return df.drop("_pairs", "_parsed", "_exact", "_loose")


def unmask_with(replies: DataFrame, mapping: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """unmask for a mapping that is a table (keys, ord, token, original): the placeholders of a key are gathered, a map
    of at most as many entries as its document has names, and joined to its replies."""
    keys = keys or ("doc_id",)
    pairs = F.array_sort(F.collect_list(F.struct("ord", "token", "original")))
    maps = mapping.groupBy(*keys).agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["token"], p["original"]))).alias("_map"))
    joined = replies.join(maps, list(keys), "left").withColumn("_map", F.coalesce("_map", F.create_map().cast("map<string,string>")))
    return unmask(joined, text, "_map").drop("_map")
