import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _hash long, copies int, _word string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau".split()


@pytest.fixture(scope="session")
def rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, equal ids, near copies, odd white space."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = [say(r.randint(1, 60)) for _ in range(30)]
    long = say(40_000)
    texts = [None, "", "   \t", "one", "One", "ONE two", "x\x0by\x0cz\x1fq", "é É 株式会社 𠮷", "12 34 !!", *base, base[3], base[3].upper(), base[4] + " tail", "head " + base[5], long, long, "lead " + long]
    out = [(i, t, (None, "en", "fr")[i % 3], (None, "a", "b", "", "a")[i % 5], None if t is None else len(t), "r", 1, 2, "w") for i, t in enumerate(texts)]
    out += [out[12], out[12], (12, base[9], "en", "a", 1, None, None, None, None), (None, base[3], "en", "b", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture()
def docs(spark, rows, tmp_path):
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def empty(spark, tmp_path):
    path = f"file://{tmp_path}/none.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def scratch(spark):
    from sparkveil.llm.common import Scratch

    return Scratch(spark, "test")
