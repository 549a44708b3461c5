"""Japanese texts and spans made from the tables by SQL that both Spark and the oracle run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORES = ("アサギ工房", "ルリ物産", "コハク電機", "ヒスイ運輸", "スズカゼ印刷", "ハナミズキ書店", "ツバキ製作所", "カエデ建設", "シラカバ食品", "クスノキ化学", "ナデシコ薬局", "ワカバ出版", "ミズナラ家具", "アカネ繊維", "ソラマメ通信", "ユズリハ企画")
SURNAMES = ("青柳", "石清水", "卯月", "榎", "小野寺", "神無月", "久遠", "桜庭", "東雲", "高千穂", "千早", "常盤")
HONORIFICS = ("様", "さん", "部長", "氏", "先生", "課長")


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _names(key: str, values) -> str:
    return _case(f"{key} % {len(values)}", [f"'{v}'" for v in values])


def _digits(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR(20)), {n}, '0')"


_CORE = _names("o_custkey", CORES)
_ORG = _case("o_orderkey % 6", [f"'株式会社' || {_CORE}", f"{_CORE} || '株式会社'", f"'(株)' || {_CORE}", f"'㈱' || {_CORE}", f"'有限会社' || {_CORE}", f"{_CORE} || '御中'"])
_PERSON = f"{_case('o_orderkey % 4', ["'営業部'", "''", "'担当の'", "'本日、'"])} || {_names('o_orderkey', SURNAMES)} || {_names('o_custkey', HONORIFICS)}"
_A, _B = _digits("o_orderkey * 7 % 10000", 4), _digits("o_custkey * 31 % 10000", 4)
_PHONE = _case("o_orderkey % 5", [f"'03-' || {_A} || '-' || {_B}", f"'090ー' || {_A} || 'ー' || {_B}", "'0120-123-456'", f"'080' || {_A} || {_B}", f"'０３-' || {_A} || '-' || {_B}"])
_NUMBER = f"{_digits('(o_orderkey * 7919 + o_custkey * 104729) % 100000000000', 11)} || CAST(o_custkey % 10 AS VARCHAR(2))"
_PLACE = _case("o_orderkey % 5", [f"'〒' || {_digits('o_orderkey % 1000', 3)} || '-' || {_A} || ' 東京都青葉区旭町1-2-' || CAST(o_custkey % 30 AS VARCHAR(3))", "'大阪府の気候'", "'神奈川県横浜市旭町'", "'東京都都民会館'", "'北海道'"])
_TAIL = _case("o_orderkey % 7", ["'[[組織_1]]を参照'", "'[人名_2]は別件'", f"{_CORE} || 'の件'", f"{_CORE} || 'ビル前'", "'以上'", "''", "'担当者様へ'"])
_MAIL = "'user' || CAST(o_orderkey AS VARCHAR(20)) || '@example.co.jp'"

JA_DOCS = f"SELECT CAST(o_orderkey AS BIGINT) AS doc_id, {_ORG} || 'の件。' || {_PERSON} || 'より連絡。電話は' || {_PHONE} || '、番号' || {_NUMBER} || '。' || {_PLACE} || '。' || {_MAIL} || ' まで。' || {_TAIL} AS text FROM orders"

#: Half of the cores are in the dictionary, each second one with a legal form, and with an alias.
DICTIONARY = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{'株式会社' if i % 4 == 0 else ''}{c}', '{'ORGANIZATION' if i % 6 else ''}', '{c[:3] + '本社' if i % 4 == 0 else ''}')" for i, c in enumerate(CORES) if i % 2 == 0)
    + ") AS d(ord, name, type, aliases)"
)

#: Spans as detectors might give them for one document, with overlaps and touches.
SPANS = """
SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS seq, CAST(p % 40 AS INT) AS start,
       CAST(p % 40 + 1 + u % 12 AS INT) AS "end",
       CASE p % 3 WHEN 0 THEN 'ORGANIZATION' WHEN 1 THEN 'PERSON' ELSE 'PHONE' END AS type,
       CASE p % 2 WHEN 0 THEN 1.0E0 ELSE 0.9E0 END AS score,
       CASE u % 5 WHEN 0 THEN 'denylist' WHEN 1 THEN 'structural' WHEN 2 THEN 'regex' WHEN 3 THEN 'ner' ELSE 'propagation' END AS source
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS u FROM lineitem GROUP BY l_orderkey, l_linenumber) AS g
"""

#: Four documents to a page, so that names of a type are several.
JA_PAGES = f"SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, string_agg(text, '\n' ORDER BY doc_id) AS text FROM ({JA_DOCS}) AS d GROUP BY floor(doc_id / 4)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql.replace(chr(34), "`"))


def ja_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, JA_DOCS, "orders")


def ja_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ja_docs(spark, sf_dir)
    each = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return docs.groupBy(F.floor(F.col("doc_id") / 4).alias("doc_id")).agg(F.array_join(F.transform(each, lambda d: d["text"]), "\n").alias("text"))


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, SPANS, "lineitem")
