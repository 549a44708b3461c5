"""Dictionaries of known names: CSV files with the columns name, type and aliases (split by |)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import legal_form
from ..functions.scan import none
from ..functions.shadow import folded, shadow

SCHEMA = "name string, type string, aliases array<string>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^[{K.SPACE}]+|[{K.SPACE}]+$", "")


def tidy(raw: DataFrame) -> DataFrame:
    """(name, type, aliases) of raw rows: columns are found by name, one that is missing is empty; rows without a name
    go; an unknown or empty type is an organisation; aliases are split and trimmed, empty ones go."""
    col = lambda n: _strip(F.col(n).cast("string")) if n in raw.columns else F.lit("")
    kind = F.when(col("type").isin(*K.TYPES), col("type")).otherwise(F.lit(K.ORGANIZATION))
    aliases = F.filter(F.transform(F.split(col("aliases"), r"\|"), _strip), lambda a: a != "")
    return raw.select(col("name").alias("name"), kind.alias("type"), aliases.alias("aliases")).filter("name <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file; values are text, nothing is inferred."""
    return tidy(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8"))


def exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_both(spark: SparkSession, clients: str | None, persons: str | None) -> DataFrame:
    """Clients, then persons, whose type is always PERSON; a file that isn't there is left out."""
    out = spark.createDataFrame([], SCHEMA)
    if exists(spark, clients):
        out = out.unionByName(read_csv(spark, clients))
    if exists(spark, persons):
        out = out.unionByName(read_csv(spark, persons).withColumn("type", F.lit(K.PERSON)))
    return out


def choose(spark: SparkSession, explicit: str | None, clients: str | None, persons: str | None) -> DataFrame:
    """The explicit file alone if it exists, else the configured ones."""
    return read_csv(spark, explicit) if exists(spark, explicit) else read_both(spark, clients, persons)


def variants(name: Column, aliases: Column, min_core: int = K.MIN_CORE) -> Column:
    """Array of folded keys of an entry: the name; if it has a legal form, its core with each of DICTIONARY_FORMS before
    and behind it, and the core alone if it has min_core characters; the aliases."""
    form = legal_form(name)
    core = form["core"]
    has = form["form"].isNotNull() & (core != "")
    formed = F.array(*[c for f in K.DICTIONARY_FORMS for c in (F.concat(F.lit(f), core), F.concat(core, F.lit(f)))])
    alone = F.when(F.length(core) >= min_core, F.array(core)).otherwise(none("array<string>"))
    every = F.concat(F.array(name), F.when(has, F.concat(formed, alone)).otherwise(none("array<string>")), F.coalesce(aliases, none("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, lambda v: folded(shadow(v)["s"])), lambda v: v != ""))


def keys(dictionary: DataFrame, min_core: int = K.MIN_CORE) -> DataFrame:
    """(key, type): one row for each folded key; of entries with the same key the first gives the type, by `ord` if the
    dictionary has that column, else in the order of its rows."""
    d = dictionary if "ord" in dictionary.columns else dictionary.withColumn("ord", F.monotonically_increasing_id())
    each = d.select("ord", "type", F.explode(variants(F.col("name"), F.col("aliases"), min_core)).alias("key"))
    return each.groupBy("key").agg(F.min_by("type", "ord").alias("type"))


def collect_keys(dictionary: DataFrame, min_core: int = K.MIN_CORE) -> list[tuple[str, str]]:
    """The keys on the driver, for a plan's literal: a dictionary is written by people, its size doesn't follow the texts."""
    return sorted((r.key, r.type) for r in keys(dictionary, min_core).collect())


def automaton_spans(found_keys: list[tuple[str, str]]):
    """A vectorised function text -> spans for large dictionaries: one automaton for all keys runs over each folded text.
    Same result as operators.detect.dictionary_spans on the text's shadow, in offsets of the text."""
    held = list(found_keys)

    @F.pandas_udf(K.SPANS)
    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        import ahocorasick

        tree = ahocorasick.Automaton()
        for k, t in held:
            tree.add_word(k, (len(k), t))
        tree.make_automaton()

        def one(text):
            if not text:
                return []
            chars, back = [], []
            for i, c in enumerate(text):
                for n in c if c.isascii() else unicodedata.normalize("NFKC", c):
                    if not n.isspace():
                        chars.append("-" if n in K.HYPHENS else n)
                        back.append(i)
            if not chars:
                return []
            return [
                {"start": back[end - size + 1], "end": back[end] + 1, "type": t, "score": 1.0, "sources": ["denylist"]}
                for end, (size, t) in tree.iter("".join(chars))
            ]

        return texts.map(one)

    return run
