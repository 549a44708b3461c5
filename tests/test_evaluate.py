import pytest
from pyspark.sql import functions as F

from sparkveil.functions import constants as K
from sparkveil.plans import evaluate as E
from sparkveil.plans import pipeline as P
from sparkveil.sources.settings import Settings

CASES = [
    ("a", "org-prefix", "本日、株式会社ハルカゼ商会と面談。", [("株式会社ハルカゼ商会", K.ORGANIZATION, None)]),
    ("b", "org-core", "アサギ工房から返信。", [("アサギ工房", K.ORGANIZATION, None)]),
    ("c", "mixed", "営業部青柳様 a@b.jp 03-1234-5678", [("青柳", K.PERSON, None), ("a@b.jp", K.EMAIL, None), ("03-1234-5678", K.PHONE, None)]),
    ("d", "signature", "東雲太郎", [("東雲太郎", K.PERSON, None)]),
    ("e", "address", "東京都青葉区旭町1-2", [("東京都青葉区旭町1-2", K.ADDRESS, None)]),
    ("f", "trap", "2026-07-07 と皆様", []),
    ("g", "core-propagation", "株式会社ハルカゼ商会。ハルカゼ商会は", [("株式会社ハルカゼ商会", K.ORGANIZATION, None), ("ハルカゼ商会", K.ORGANIZATION, 1)]),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(*c, "") for c in CASES], "id string, category string, text string, entities array<struct<surface:string,type:string,nth:int>>, note string")


def plan(spark, disabled=None):
    entries = spark.createDataFrame([("アサギ工房", K.ORGANIZATION, [])], "name string, type string, aliases array<string>")
    return P.without(spark, disabled, use_address=True, config=Settings(), entries=entries)


def test_figures(spark, cases):
    judged = E.judge(plan(spark).detect(E.with_gold(cases))).cache()
    t = E.totals(judged).collect()[0]
    assert (t.gold, t.pred, t.found, t.right) == (9, 8, 8, 8)
    assert t.precision == 1.0 and abs(t.recall - 8 / 9) < 1e-9 and abs(t.f1 - 16 / 17) < 1e-9
    assert [tuple(r) for r in E.misses(judged).collect()] == [("d", "東雲太郎", K.PERSON)] and E.false_alarms(judged).count() == 0
    assert {r.type: (r.found, r.gold) for r in E.by_type(judged).collect()}[K.PERSON] == (1, 2)
    lost = {r.layer: r.lost for r in E.ablation(cases, lambda d: plan(spark, d), ["regex", "denylist"]).collect()}
    assert abs(lost["regex"] - 2 / 9) < 1e-9 and abs(lost["denylist"] - 1 / 9) < 1e-9
    checks = {r.name: r for r in E.thresholds(judged, cases).collect()}
    assert not checks["overall recall (partial)"].ok and checks["overall precision"].ok and checks["recall org with legal form"].measured == 1.0
    none_left = E.thresholds(judged, cases.filter("category <> 'org-core'")).filter("name = 'recall dictionary clients'").collect()[0]
    assert none_left.measured == 0.0 and not none_left.ok
    text = E.summary(judged, len(CASES), lost)
    assert "gold spans 9" in text and "d PERSON 東雲太郎" in text
    assert E.spliced(f"x\n{E.BEGIN}\nold\n{E.END}\ny", text) == f"x\n{text}\ny"
    with pytest.raises(ValueError):
        E.spliced("no marks", text)


def test_half_of_everything(spark):
    span = lambda a, b, k: (a, b, k, 1.0, ["x"])
    rows = [("1", "c", "x" * 20, [span(0, 4, K.PERSON), span(5, 9, K.PERSON)], [span(0, 4, K.PERSON), span(5, 9, K.EMAIL)])]
    df = spark.createDataFrame(rows, f"id string, category string, text string, gold {K.SPANS}, spans {K.SPANS}")
    t = E.totals(E.judge(df)).collect()[0]
    assert (t.recall, t.precision, t.f1, t.exact_recall) == (0.5, 0.5, 0.5, 0.5)
    nothing = E.totals(E.judge(df.filter(F.lit(False)))).collect()[0]
    assert (nothing.recall, nothing.precision, nothing.f1) == (1.0, 1.0, 1.0)


def test_nth_and_longest_first(spark):
    ents = [("柳", K.PERSON, None), ("青柳", K.PERSON, None), ("東", K.PERSON, 1), ("空", K.PERSON, 5), ("", K.PERSON, None)]
    df = spark.createDataFrame([("x", "c", "青柳と柳と東と東", ents, "")], "id string, category string, text string, entities array<struct<surface:string,type:string,nth:int>>, note string")
    assert [(s.start, s.end) for s in E.with_gold(df).collect()[0].gold] == [(0, 2), (3, 4), (7, 8)]


def test_own_corpus(spark):
    """All least figures are reached on the engine's own cases, and each layer is needed for them."""
    from sparkveil.plans import plan_queries as Q

    judged, cases = Q._judged(spark)
    judged = judged.cache()
    t = E.totals(judged).collect()[0]
    assert cases.count() == len(Q.corpus.CASES) >= 90 and t.gold >= 200
    assert t.recall >= 0.98 and t.precision >= 0.99 and t.f1 >= 0.985
    assert all(r.ok for r in E.thresholds(judged, cases).collect())
    assert {r.surface for r in E.misses(judged).collect()} == {"ABC工業", "常盤 一葉", "カワセミ"}
    assert all(r.lost > 0.02 for r in E.ablation(cases, lambda d: Q._corpus_plan(spark, d), ["regex", "structural", "denylist", "address"]).collect())
