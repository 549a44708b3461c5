"""Evaluation: how much of what should be found is found. Cases are rows (id, category, text, entities); each is judged
within its row, and only counts are shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scan import between
from ..operators.detect import gold_spans
from .pipeline import Plan

CASES = "id string, category string, text string, entities array<struct<surface:string,type:string,nth:int>>, note string"

LEGAL_FORM_CATEGORIES = ("org-prefix", "org-suffix", "org-abbr", "org-glyph", "org-fullwidth")
DICTIONARY_CATEGORIES = ("org-core", "dict-variant")
LEAST = {"recall": 0.95, "precision": 0.70, "legal form": 0.98, "dictionary": 1.0, "regex": 1.0}
REGEX_TYPES = (K.EMAIL, K.PHONE, K.MYNUMBER)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path, multiLine=True)


def _touch(a, b) -> Column:
    return (a["type"] == b["type"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def _equal(a, b) -> Column:
    return (a["type"] == b["type"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])


def judge(cases: DataFrame, pred: str = "spans", gold: str = "gold") -> DataFrame:
    """(id, category, side, type, surface, start, end, sources, hit, exact): a row for each gold span, with whether it is
    found at least in part and whether exactly, and for each predicted span, with whether it is right."""
    t = F.col("text")
    side = lambda name, mine, other: F.transform(
        F.col(mine),
        lambda a: F.struct(
            F.lit(name).alias("side"), a["type"].alias("type"), between(t, a["start"], a["end"]).alias("surface"), a["start"].alias("start"), a["end"].alias("end"), a["sources"].alias("sources"),
            F.exists(F.col(other), lambda b: _touch(a, b)).alias("hit"), F.exists(F.col(other), lambda b: _equal(a, b)).alias("exact"),
        ),
    )
    return cases.select("id", "category", F.explode(F.concat(side("gold", gold, pred), side("pred", pred, gold))).alias("j")).select("id", "category", "j.*")


def with_gold(cases: DataFrame) -> DataFrame:
    return cases.withColumn("gold", gold_spans(F.col("text"), F.col("entities")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(1.0))


def totals(judged: DataFrame, *keys: str) -> DataFrame:
    """gold, pred, found, found_exactly, right, recall, exact_recall, precision, f1; nothing to find or found counts as 1."""
    gold, pred = F.col("side") == "gold", F.col("side") == "pred"
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    sums = [n(gold, "gold"), n(pred, "pred"), n(gold & F.col("hit"), "found"), n(gold & F.col("exact"), "found_exactly"), n(pred & F.col("hit"), "right")]
    out = judged.groupBy(*keys).agg(*sums)
    out = out.withColumn("recall", _ratio(F.col("found"), F.col("gold"))).withColumn("exact_recall", _ratio(F.col("found_exactly"), F.col("gold"))).withColumn("precision", _ratio(F.col("right"), F.col("pred")))
    both = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def by_type(judged: DataFrame) -> DataFrame:
    """(type, gold, found, recall) of gold spans."""
    g = judged.filter("side = 'gold'").groupBy("type").agg(F.count(F.lit(1)).alias("gold"), F.sum(F.col("hit").cast("long")).alias("found"))
    return g.withColumn("recall", F.col("found") / F.col("gold"))


def misses(judged: DataFrame) -> DataFrame:
    return judged.filter("side = 'gold' AND NOT hit").select("id", "surface", "type")


def false_alarms(judged: DataFrame) -> DataFrame:
    return judged.filter("side = 'pred' AND NOT hit").select("id", "surface", "type")


def by_source(cases: DataFrame, names: list[str], pred: str = "spans", gold: str = "gold") -> DataFrame:
    """(source, lost): how much recall falls if spans with a source are left out. For raw spans, each of one source."""
    rows = cases.select(F.explode(gold).alias("g"), F.col(pred).alias("p"))

    def without_source(name):
        return lambda b: ~F.array_contains(b["sources"], name)

    hit = lambda c: F.avg(F.exists(F.filter("p", c), lambda b: _touch(F.col("g"), b)).cast("int"))
    one = rows.agg(hit(lambda _: F.lit(True)).alias("all"), *[hit(without_source(n)).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("source"), (F.col("all") - F.col(n)).alias("lost")) for n in names])).alias("x")).select("x.*")


def ablation(cases: DataFrame, plan_without: Callable[[str | None], Plan], layers: list[str]) -> DataFrame:
    """(layer, lost): how much recall falls if a plan is built without a layer and run anew."""
    gold = with_gold(cases)
    parts = [totals(judge(plan_without(n).detect(gold))).select(F.lit(n or "").alias("layer"), "recall") for n in (None, *layers)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    full = all_.filter("layer = ''").select(F.col("recall").alias("full"))
    return all_.filter("layer <> ''").crossJoin(F.broadcast(full)).select("layer", (F.col("full") - F.col("recall")).alias("lost"))  # one row


def thresholds(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """(name, measured, least, ok). A part of the cases that is empty fails."""
    t = totals(judged)
    org = (F.col("side") == "gold") & (F.col("type") == K.ORGANIZATION)

    def part(name, categories, least):
        there = cases.filter(F.col("category").isin(*categories)).agg((F.count(F.lit(1)) > 0).alias("there"))
        m = judged.filter(org & F.col("category").isin(*categories)).agg(_ratio(F.sum(F.col("hit").cast("int")), F.count(F.lit(1))).alias("m"))
        return m.crossJoin(there).select(F.lit(name).alias("name"), F.when(F.col("there"), F.coalesce("m", F.lit(1.0))).otherwise(F.lit(0.0)).alias("measured"), F.lit(least).alias("least"))  # one row each

    rows = [t.select(F.lit("overall recall (partial)").alias("name"), F.col("recall").alias("measured"), F.lit(LEAST["recall"]).alias("least"))]
    rows.append(t.select(F.lit("overall precision").alias("name"), F.col("precision").alias("measured"), F.lit(LEAST["precision"]).alias("least")))
    for k in REGEX_TYPES:
        one = judged.filter((F.col("side") == "gold") & (F.col("type") == k)).agg(F.coalesce(_ratio(F.sum(F.col("hit").cast("int")), F.count(F.lit(1))), F.lit(1.0)).alias("measured"))
        rows.append(one.select(F.lit(f"recall {k.lower()}").alias("name"), "measured", F.lit(LEAST["regex"]).alias("least")))
    rows += [part("recall dictionary clients", DICTIONARY_CATEGORIES, LEAST["dictionary"]), part("recall org with legal form", LEGAL_FORM_CATEGORIES, LEAST["legal form"])]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("ok", F.col("measured") >= F.col("least"))


def summary(judged: DataFrame, n_cases: int, lost: dict[str, float] | None = None) -> str:
    """The figures as Markdown, between two marks by which an older block can be replaced."""
    t = totals(judged).collect()[0]
    kinds = {r.type: r for r in by_type(judged).collect()}
    missed, alarms = misses(judged).orderBy("id", "surface").limit(50).collect(), false_alarms(judged).orderBy("id", "surface").limit(50).collect()
    lines = [BEGIN, "", f"cases {n_cases}, gold spans {t.gold}, predicted spans {t.pred}", "", "| metric | value |", "|---|---|"]
    lines += [f"| {n} | {v:.4f} |" for n, v in (("recall", t.recall), ("exact recall", t.exact_recall), ("precision", t.precision), ("F1", t.f1))]
    lines += [f"| recall {k} | {kinds[k].recall:.4f} ({kinds[k].found} / {kinds[k].gold}) |" for k in K.TYPES if k in kinds]
    lines += [f"| lost without {k} | {v:.4f} |" for k, v in sorted((lost or {}).items(), key=lambda x: -x[1])]
    lines += ["", "missed: " + (", ".join(f"{r.id} {r.type} {r.surface}" for r in missed) or "none"), "false alarms: " + (", ".join(f"{r.id} {r.type} {r.surface}" for r in alarms) or "none"), "", END]
    return "\n".join(lines)


BEGIN, END = "<!-- figures -->", "<!-- end of figures -->"


def spliced(doc: str, block: str) -> str:
    """A document with its block of figures replaced; one without marks is an error."""
    a, b = doc.find(BEGIN), doc.find(END)
    if a < 0 or b < a:
        raise ValueError("the document has no block of figures")
    return doc[:a] + block + doc[b + len(END) :]
