"""From overlapping spans of all detectors to disjoint ones: widen, merge, spread, widen, merge.

Two forms with the same results. The array form works within a row: nothing is shuffled, and it also runs in a stream.
The row form works on tables of spans with windows; it is for spans that come as rows, of which a document may have more
than an array should hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.scalars import legal_form
from ..functions.scan import between, held, literal, none, span, starts
from ..functions.shadow import shadow, to_shadow, to_text

_LONGEST = max(map(len, K.LEGAL_FORMS))


def priority(sources: Column) -> Column:
    """The greatest priority of a span's sources; 0 for unknown ones."""
    known = F.transform(sources, lambda s: reduce(lambda c, kv: F.when(s == kv[0], F.lit(kv[1])).otherwise(c), K.PRIORITY.items(), F.lit(0)))
    return F.coalesce(F.array_max(known), F.lit(0))


def _fit(text: Column, test) -> Column:
    return F.greatest(*[F.when(test(text, F.lit(f)), F.lit(len(f))).otherwise(F.lit(0)) for f in K.LEGAL_FORMS])


def wider(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A range with the longest legal forms that stand right before and right behind it in the text."""
    after = F.substring(text, end + 1, F.lit(_LONGEST))
    from_ = F.greatest(start - _LONGEST, F.lit(0))
    before = between(text, from_, start)
    return start - _fit(before, F.endswith), end + _fit(after, F.startswith)


# ---- array form ----------------------------------------------------------------------------------------------------


def widen(text: Column, found: Column) -> Column:
    """The spans, then a wider copy of each organisation that has legal forms beside it."""

    def copy(s):
        first, last = wider(text, s["start"], s["end"])
        return F.struct(s.alias("was"), span(first, last, s["type"], s["score"], F.concat(s["sources"], F.array(F.lit("boundary")))).alias("new"))

    orgs = F.transform(F.filter(found, lambda s: s["type"] == K.ORGANIZATION), copy)
    changed = F.filter(orgs, lambda o: (o["was"]["start"] != o["new"]["start"]) | (o["was"]["end"] != o["new"]["end"]))
    return F.concat(found, F.transform(changed, lambda o: o["new"]))


_GROUP = "array<struct<start:int,end:int,type:string,score:double,sources:array<string>,p:int,n:int>>"


def merge(found: Column) -> Column:
    """Spans that overlap, directly or through others, become one: its range is theirs together, its type that of the
    span of greatest priority, then of the longest, then of the first by start, longer end and order of finding. Spans
    that only touch stay apart."""
    keyed = F.transform(
        found,
        lambda s, i: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("i"), s["type"].alias("type"), s["score"].alias("score"), s["sources"].alias("sources"), priority(s["sources"]).alias("p"), (s["end"] - s["start"]).alias("n")
        ),
    )

    def step(acc, s):
        end = -s["back"]
        new = F.struct(s["start"].alias("start"), end.alias("end"), s["type"].alias("type"), s["score"].alias("score"), F.array_distinct(s["sources"]).alias("sources"), s["p"].alias("p"), s["n"].alias("n"))
        last = F.element_at(acc, -1)
        wins = (s["p"] > last["p"]) | ((s["p"] == last["p"]) & (s["n"] > last["n"]))
        both = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], end).alias("end"),
            F.when(wins, s["type"]).otherwise(last["type"]).alias("type"),
            F.greatest(last["score"], s["score"]).alias("score"),
            F.array_union(last["sources"], s["sources"]).alias("sources"),
            F.when(wins, s["p"]).otherwise(last["p"]).alias("p"),
            F.when(wins, s["n"]).otherwise(last["n"]).alias("n"),
        )
        joins = (F.size(acc) > 0) & (s["start"] < last["end"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(new)))

    merged = F.aggregate(F.array_sort(keyed), none(_GROUP), step)
    return F.transform(merged, lambda s: span(s["start"], s["end"], s["type"], s["score"], s["sources"]))


_CANDIDATES = "array<struct<q:string,type:string,score:double,sources:array<string>,a:int,b:int>>"


def _first_of_each(items: Column, kind: str) -> Column:
    """Items (q, type, ...) without those whose q and type came before."""
    seen = lambda acc, c: F.exists(acc, lambda x: (x["q"] == c["q"]) & (x["type"] == c["type"]))
    return F.aggregate(items, none(kind), lambda acc, c: F.when(seen(acc, c), acc).otherwise(F.concat(acc, F.array(c))))


def candidates(text: Column, found: Column) -> Column:
    """What may be found again: surfaces with their types, and cores of organisations without their legal form; with the
    place of each, a to b."""

    def variants(s):
        surface = between(text, s["start"], s["end"])

        def make(q, a, b):
            return F.struct(q.alias("q"), s["type"].alias("type"), s["score"].alias("score"), s["sources"].alias("sources"), a.cast("int").alias("a"), b.cast("int").alias("b"))

        form = legal_form(surface)
        core = (s["type"] == K.ORGANIZATION) & form["form"].isNotNull() & (F.length(form["core"]) >= K.MIN_CORE_SPREAD)
        whole = make(surface, s["start"], s["end"])
        first = F.when(F.startswith(surface, form["form"]), s["start"] + F.length(form["form"])).otherwise(s["start"])
        return F.when(core, F.array(whole, make(form["core"], first, first + F.length(form["core"])))).otherwise(F.array(whole))

    long_enough = F.filter(F.flatten(F.transform(found, variants)), lambda c: F.length(c["q"]) >= K.MIN_SPREAD)
    return _first_of_each(long_enough, _CANDIDATES)


def spread(text: Column, found: Column, sh: Column) -> Column:
    """The spans, then other occurrences of what they hold. Surfaces are compared in the shadow, longer ones first; an
    occurrence that touches a span or an earlier occurrence, or stands within a longer name, doesn't count. sh: the
    shadow, which should be a column, as each occurrence looks at it."""
    s, x = sh["s"], sh["x"]
    # characters are shadowed one by one, so that a surface's shadow is a part of the text's
    part = lambda c: between(s, to_shadow(x, c["a"]), to_shadow(x, c["b"]))
    shadowed = F.transform(candidates(text, found), lambda c: F.struct(part(c).alias("q"), *[c[k].alias(k) for k in ("type", "score", "sources", "a", "b")]))
    unique = _first_of_each(F.filter(shadowed, lambda c: F.length(c["q"]) >= K.MIN_SPREAD), _CANDIDATES)
    ordered = F.array_sort(F.transform(unique, lambda c, i: F.struct((-F.length(c["q"])).alias("k"), i.alias("i"), c.alias("c"))))
    taken = F.transform(found, lambda f: F.struct(to_shadow(x, f["start"]).alias("s"), to_shadow(x, f["end"]).alias("e")))
    acc0 = F.struct(taken.cast("array<struct<s:int,e:int>>").alias("taken"), none(K.SPANS).alias("new"))
    continues = lambda c: F.regexp_like(c, F.lit(f"^[{K.NAME_CHARS}]$"))

    def each(acc, o):
        c = o["c"]
        size = F.length(c["q"])

        def one(a, at):
            end = at + size
            before = F.when(at > 0, F.substring(s, at, F.lit(1))).otherwise(F.lit(""))
            free = ~F.exists(a["taken"], lambda t: (t["s"] < end) & (at < t["e"])) & ~continues(before) & ~continues(F.substring(s, end + 1, F.lit(1)))
            first, last = to_text(x, at, end)
            new = span(first, last, c["type"], c["score"], F.concat(c["sources"], F.array(F.lit("propagation"))))
            more = F.struct(F.concat(a["taken"], F.array(F.struct(at.alias("s"), end.alias("e")))).alias("taken"), F.concat(a["new"], F.array(new)).alias("new"))
            return F.when(free, more).otherwise(a)

        return F.aggregate(starts(s, literal(c["q"])), acc, one)

    return F.concat(found, F.aggregate(ordered, acc0, each, lambda a: a["new"]))


def merge_spans(df: DataFrame, text: str = "text", found: str = "spans", sh: Column | None = None) -> DataFrame:
    """df with disjoint spans in place of the detectors'. Each step is a projection; rows without spans pass through.
    sh: the text's shadow if there is a column of it."""
    t, f = F.col(text), F.col(found)
    if sh is None:
        return merge_spans(df.withColumn("_sh", held(shadow(t))), text, found, F.col("_sh")).drop("_sh")
    some = lambda made: F.when(F.size(f) > 0, made).otherwise(f)
    for step in (lambda: widen(t, f), lambda: merge(f), lambda: spread(t, f, sh), lambda: widen(t, f), lambda: merge(f)):
        df = df.withColumn(found, held(some(step())))
    return df


# ---- row form ------------------------------------------------------------------------------------------------------


def widen_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, seq, text, start, end, type, score, sources) with the wider copies, whose seq is beyond all others."""
    first, last = wider(F.col("text"), F.col("start"), F.col("end"))
    w = rows.filter(F.col("type") == K.ORGANIZATION).withColumn("_s", first.cast("int")).withColumn("_e", last.cast("int")).filter("_s <> start OR _e <> end")
    w = w.withColumn("start", F.col("_s")).withColumn("end", F.col("_e")).drop("_s", "_e")
    w = w.withColumn("sources", F.concat("sources", F.array(F.lit("boundary")))).withColumn("seq", F.col("seq") + (1 << 30))
    return rows.unionByName(w)


def merge_rows(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """merge() for rows (doc, seq, start, end, type, score, sources): one shuffle, by document, serves the windows and
    the aggregation."""
    order = Window.partitionBy(doc).orderBy("start", F.desc("end"), "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = marked.withColumn("_nth", F.row_number().over(order)).withColumn("_key", F.struct(priority(F.col("sources")).alias("p"), (F.col("end") - F.col("start")).alias("n"), (-F.col("_nth")).alias("i")))
    by_order = F.array_sort(F.collect_list(F.struct("_nth", "sources")))
    out = ranked.groupBy(doc, "_group").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max_by("type", "_key").alias("type"),
        F.max("score").alias("score"),
        F.array_distinct(F.flatten(F.transform(by_order, lambda s: s["sources"]))).alias("sources"),
    )
    return out.drop("_group")


def as_rows(df: DataFrame, found: str = "spans", *keys: str) -> DataFrame:
    """One row for each span: keys, seq, start, end, type, score, sources."""
    keys = keys or ("doc_id",)
    return df.select(*keys, F.posexplode(found).alias("seq", "_s")).select(*keys, "seq", "_s.*")
