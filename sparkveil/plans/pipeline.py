"""Plans: which layers look at a text, and what becomes of it. A plan is a chain of projections; no row leaves its task, but
that rows of a small input are dealt to all cores before. The optimizer doesn't move filters below a plan's projections, so
that rows that aren't wanted should be filtered before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scan import held, none
from ..functions.shadow import folded, shadow
from ..operators import additive, detect
from ..operators.mask import mask as mask_spans
from ..operators.merge import merge_spans
from ..operators.unmask import unmask as unmask_text_column
from ..sources import dictionary, settings

#: All layers, in the order in which their spans are gathered; and those that are always on.
LAYERS = ("regex", "structural", "denylist", "address", "ner")
BASE = ("regex", "structural", "denylist")
#: Dictionary keys that a plan holds as a literal; more go through an automaton.
LITERAL_KEYS = 500


#: Bytes of input for each core up to which rows are dealt out before they are scanned.
SMALL_INPUT = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df with its rows dealt to all cores if it is small: one file with one row group is one task, however many cores wait,
    and a scan costs far more than moving the row. Larger inputs, and streams, have tasks enough and stay as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_INPUT else df


@dataclass(frozen=True)
class Plan:
    """Layers with what they need. spans() gives their raw spans, detect() disjoint ones. types: which of them are looked
    for; what is of another type stays in the text and is no part of any merge."""

    layers: tuple[str, ...]
    config: settings.Settings = settings.Settings()
    keys: tuple[tuple[str, str], ...] = ()
    recogniser: Callable | str | None = None
    client: Callable[[str], str] | None = field(default=None, compare=False)
    types: tuple[str, ...] = K.TYPES

    def _layer(self, name: str, s: Column, fold: Column) -> Column:
        c = self.config
        if name == "regex":
            return detect.regex_spans(s, c.extra_patterns, self.types)
        if name == "structural":
            return detect.structural_spans(s, c.person_max, c.org_max, c.person_stopwords)
        if name == "denylist":
            return detect.dictionary_spans(s, list(self.keys), fold)
        if name == "address":
            return detect.address_spans(s)
        return none(K.SPANS)

    def _wanted(self, spans: Column) -> Column:
        return spans if set(self.types) >= set(K.TYPES) else F.filter(spans, lambda s: s["type"].isin(*self.types))

    def spans(self, df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
        """df with the raw spans of all layers, and `_shadow`."""
        t = F.coalesce(F.col(text), F.lit(""))
        df = dealt(df).withColumn("_shadow", held(shadow(t))).withColumn("_fold", held(folded(F.col("_shadow.s"))))
        s, x = F.col("_shadow.s"), F.col("_shadow.x")
        parts = []
        for name in self.layers:
            if name == "ner":
                parts.append(additive.ner_spans(t, self.recogniser or self.config.ner_engine, self.config.ner_score))
            elif name == "denylist" and len(self.keys) > LITERAL_KEYS:
                parts.append(dictionary.automaton_spans(list(self.keys))(t))
            else:
                parts.append(detect.in_text(self._layer(name, s, F.col("_fold")), x))
        return df.withColumn(to, held(self._wanted(F.concat(*parts)))).drop("_fold")

    def detect(self, df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
        df = merge_spans(self.spans(df, text, to), text, to, F.col("_shadow"))
        if self.client is None:
            return df.drop("_shadow")
        df = additive.ask_model(df, self.client, self.config.llm_chunk, text, to)
        df = df.withColumn("_more", self._wanted(F.col("_more")))
        had = F.size("_more") > 0
        df = df.withColumn("_merged", F.col(to)).withColumn(to, F.when(had, F.concat(to, "_more")).otherwise(none(K.SPANS)))
        df = merge_spans(df, text, to, F.col("_shadow")).drop("_shadow")
        return df.withColumn(to, F.when(F.size("_more") > 0, F.col(to)).otherwise(F.col("_merged"))).drop("_more", "_merged")


def build(
    spark: SparkSession,
    config: settings.Settings | None = None,
    clients: str | None = None,
    layers: set[str] | None = None,
    use_ner: bool = False,
    use_address: bool = False,
    use_llm: bool = False,
    recogniser: Callable | str | None = None,
    client: Callable[[str], str] | None = None,
    entries: DataFrame | None = None,
) -> Plan:
    """A plan. regex, structural and denylist are always there, address and ner if asked for; `layers` narrows them, an
    unknown name or an empty choice being an error. clients: a dictionary file; entries: a dictionary as a table."""
    config = config or settings.load()
    if layers is not None and (unknown := sorted(layers - set(LAYERS))):
        raise ValueError(f"unknown layers: {unknown}; there are {sorted(LAYERS)}")
    there = [n for n in LAYERS if n in BASE or n == "address" and use_address or n == "ner" and use_ner]
    chosen = tuple(n for n in there if layers is None or n in layers)
    if not chosen:
        raise ValueError("no layer is left; a plan that finds nothing isn't built")
    if use_llm and client is None:
        client = additive.http_client(config.llm_endpoint, config.llm_model, config.llm_timeout, config.llm_remote)
    keys: tuple = ()
    if "denylist" in chosen:
        table = entries if entries is not None else dictionary.choose(spark, clients, config.clients, config.persons)
        keys = tuple(dictionary.collect_keys(table, config.min_core))
    return Plan(chosen, config, keys, recogniser, client)


def without(spark: SparkSession, disabled: str | None, use_ner: bool = False, use_address: bool = False, client=None, **more) -> Plan:
    """A plan without one layer, `llm` among them; a name that isn't known is an error, as it would change nothing."""
    if disabled is not None and disabled not in (*LAYERS, "llm"):
        raise ValueError(f"unknown layer: {disabled!r}; there are {[*sorted(LAYERS), 'llm']}")
    names = {*BASE, *(["address"] if use_address else []), *(["ner"] if use_ner else [])} - {disabled}
    return build(spark, layers=names, use_ner=use_ner, use_address=use_address, client=None if disabled == "llm" else client, **more)


def mask(df: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """df with spans, masked_text, mapping and report. A null text counts as empty."""
    df = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return mask_spans(plan.detect(df, text), text)


def unmask(df: DataFrame, text: str = "masked_text", mapping: str = "mapping", to: str = "restored") -> DataFrame:
    return unmask_text_column(df, text, mapping, to)


def mask_text(spark: SparkSession, text: str, plan: Plan | None = None) -> dict:
    """One text: masked_text, mapping, report."""
    row = mask(spark.createDataFrame([(text,)], "text string"), plan or build(spark)).select("masked_text", "mapping", "report").collect()[0]
    return {"masked_text": row.masked_text, "mapping": {r.token: r.original for r in row.report}, "report": [r.asDict() for r in row.report]}


def unmask_text(spark: SparkSession, text: str, mapping: dict[str, str]) -> dict:
    """One text: restored text, warnings, unresolved."""
    df = spark.createDataFrame([(text, mapping)], "masked_text string, mapping map<string,string>")
    row = unmask(df).select("restored", "warnings", "unresolved").collect()[0]
    return {"text": row.restored, "warnings": row.warnings, "unresolved": row.unresolved}
