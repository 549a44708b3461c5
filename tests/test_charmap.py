"""The way back from a shadow by its places, against one character at a time."""

from pyspark.sql import functions as F
from test_engine import SAMPLES, one, plain_shadow

from sparkveil.functions import shadow as H
from sparkveil.plans import registry as queries

ODD = ["", "㈱", "㈱㈱", "a㈱", "㈱a", "a㈱b㌔㌔c", "㈱", "ﷺ", "𠮷㈱𠮷", "ｶﾞ①½ﬁ", "é が"]


def test_sources_of_places(spark):
    for text in [*SAMPLES[:7], *ODD]:
        s, back = plain_shadow(text)
        assert one(spark, text, lambda c: H.sources(c, H.places(c))) == back
        assert one(spark, text, H.places) == one(spark, text, lambda c: H.shadow(c)["x"])


def test_charmap_cuts_no_text_into_characters(spark):
    """Texts whose characters all stay one are looked at as a whole, however long."""
    plan = queries.QUERIES["charmap"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert ", , -1)" not in plan and "posexplode" in plan
