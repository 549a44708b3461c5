"""Queries on addresses of the documents, on documents that hold what else the regex layer looks for."""

import duckdb
import pytest
from test_oracles import plain

from sparkveil.functions import constants as K
from sparkveil.operators import detect
from sparkveil.plans import registry as queries
from sparkveil.plans.pipeline import Plan, mask

TEXTS = (
    "call 0411590525 or a.b@example.com, again a.b@example.com",
    "order 112187331997 and 0411590525",
    "x@y.org is 03-1234-5678's; <z@y.org> & x@y.org",
    "nothing",
    "",
    None,
)
NAMES = ["email_mask", "email_mapping", "email_report", "mapping_encrypted", "masked_sink", "mapping_table", "mapping_table_sealed", "review_parts", "masked_and_restored"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("typed"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_addresses_alone(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT doc_id, coalesce(text, '') AS text FROM '{folder}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, f"file://{folder}")
    r = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in r.description]
    want = sorted(tuple(map(plain, x)) for x in r.fetchall())
    assert want and sorted(tuple(plain(x[c]) for c in cols) for x in df.collect()) == want


def test_types_of_a_plan(spark, folder):
    """Without a choice all types are masked; a choice holds for configured patterns and additions of a model too."""
    d = spark.read.parquet(f"file://{folder}/documents.parquet").filter("doc_id = 0")
    types = lambda **k: [s.type for s in mask(d, Plan(("regex",), **k)).collect()[0].spans]
    assert types() == [K.PHONE, K.EMAIL, K.EMAIL]
    assert types(types=(K.PHONE,)) == [K.PHONE]
    model = lambda _: '{"additions":[{"text":"again","type":"PERSON"},{"text":"call","type":"ORGANIZATION"}]}'
    assert types(types=(K.PERSON, K.EMAIL), client=model) == [K.EMAIL, K.PERSON, K.EMAIL]
    s = d.select(detect.regex_spans(d["text"], [("or", K.PHONE), ("again", K.PERSON)], (K.PERSON,)).alias("s")).collect()[0].s
    assert [x.type for x in s] == [K.PERSON]
