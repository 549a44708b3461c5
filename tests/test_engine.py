import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkveil.functions import constants as K
from sparkveil.functions import scalars as S
from sparkveil.functions import shadow as H
from sparkveil.functions.scan import literal, matches, starts
from sparkveil.operators import additive, detect, merge
from sparkveil.operators import mask as M
from sparkveil.operators import unmask as U
from sparkveil.plans import pipeline as P
from sparkveil.sources import dictionary
from sparkveil.sources.settings import Settings


def one(spark, text, make, kind="string"):
    return spark.createDataFrame([(text,)], f"text {kind}").select(make(F.col("text")).alias("x")).collect()[0].x


def surfaces(spark, text, ranges):
    """What a detector finds, in the shadow."""
    df = spark.createDataFrame([(text,)], "text string").withColumn("s", H.shadow(F.col("text"))["s"])
    row = df.select("s", ranges(F.col("s")).alias("r")).collect()[0]
    return [row.s[r.s : r.e] for r in row.r]


# ---- shadows -------------------------------------------------------------------------------------------------------------


def plain_shadow(text):
    s, back = "", []
    for i, c in enumerate(text):
        for n in unicodedata.normalize("NFKC", c):
            s += n
            back.append(i)
    return s, back


SAMPLES = ["", "abc", "ａｂｃ１２", "㈱山田㌔…½", "ｶﾞ株", "𠮷野㈱", "゛ヿ①ⅷﷺ", "x", "é́Å"]


def test_shadow_and_way_back(spark):
    texts = SAMPLES + ["".join(H.compatibility()[1]), "".join(H.compatibility()[0])]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("sh", H.shadow(F.col("text")))
    for r in rows.collect():
        if "" not in r.text:
            assert r.sh.s == plain_shadow(r.text)[0]
    places = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.length("sh.s") - 1, F.lit(0))))).filter("at < length(sh.s)").withColumn("x", F.col("sh.x"))
    first, last = H.to_text(F.col("x"), F.col("at"), F.col("at") + 1)
    for r in places.select("text", "at", first.alias("a"), last.alias("b")).filter("i < 9").collect():
        back = plain_shadow(r.text)[1]
        assert (r.a, r.b) == (back[r.at], back[r.at] + 1)


def test_charmap_and_fold(spark):
    for text in SAMPLES[:7] + ["株式会社 アオ\nヤマ−商事　㈱"]:
        got = one(spark, text, lambda c: H.charmap(c))
        assert (got.s, got.charmap) == plain_shadow(text)
        fold = one(spark, text, lambda c: H.charmap(c, fold=True))
        assert fold.s == H.fold_python(text) == one(spark, text, lambda c: H.folded(H.shadow(c)["s"]))
        assert len(fold.charmap) == len(fold.s)


def test_bad_ranges_fail_without_text(spark):
    for a, b in ((-1, 1), (0, 9), (2, 2)):
        with pytest.raises(Exception) as e:
            one(spark, "秘密abc", lambda c, a=a, b=b: H.checked_to_text(H.shadow(c)["s"], H.shadow(c)["x"], F.lit(a), F.lit(b))[0])
        assert "秘密" not in str(e.value).split("SQLSTATE")[0]


# ---- scanning --------------------------------------------------------------------------------------------------------------


def test_literal_places_overlap(spark):
    for text, key, want in (("aaaa", "aa", [0, 1, 2]), ("abcab", "ab", [0, 3]), ("", "a", []), ("x𠮷y𠮷", "𠮷", [1, 3]), (r"a\Eb\E", r"\E", [1, 4]), ("a.b", ".", [1])):
        assert one(spark, text, lambda c, k=key: starts(c, literal(F.lit(k)))) == want


def test_matches_count_code_points(spark):
    got = one(spark, "𠮷12-345", lambda c: matches(c, "[0-9]+"))
    assert [(r.s, r.e) for r in got] == [(1, 3), (4, 6), (7, 8)]


def test_configured_patterns_with_groups(spark):
    """Groups don't shift spans; Python's names of groups are understood; what Java can't express is refused."""
    text = "x A12 y A34 z"
    for pattern, want in (("A([0-9]+)", [(2, 5), (8, 11)]), ("(?P<a_b>A)(?P<n>[0-9])[0-9]", [(2, 5), (8, 11)]), ("A1|z", [(2, 4), (12, 13)]), (r"(?P<c>[a-z]) A(?:12)|(?P=c)q", [(0, 5)])):
        (java, _), = detect.extra_patterns([{"pattern": pattern, "type": "PHONE"}])
        assert [(r.s, r.e) for r in one(spark, text, lambda c, p=java: matches(c, p))] == want
    with pytest.raises(ValueError, match="conditional"):
        detect.extra_patterns([{"pattern": "(a)?(?(1)b|c)", "type": "PHONE"}])


# ---- detectors -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("連絡はtaro.y+x@mail.example.co.jpまで", ["taro.y+x@mail.example.co.jp"]),
        ("ｔａｒｏ＠ｅｘａｍｐｌｅ．ｃｏｍ", ["taro@example.com"]),
        ("a@b はメールではない", []),
        ("x@y.c1", []),
        ("one@a.jp, two@b.org.", ["one@a.jp", "two@b.org"]),
    ],
)
def test_email(spark, text, want):
    assert surfaces(spark, text, detect.email_ranges) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("03-1234-5678", ["03-1234-5678"]),
        ("０９０ー１２３４ー５６７８", ["090ー1234ー5678"]),
        ("04992-1-2345", ["04992-1-2345"]),
        ("09012345678", ["09012345678"]),
        ("07-07-2026 と 2026-07-07", []),
        ("注文番号103-1234-5678", []),
        ("03–1234–5678", []),
        ("1234567890123", []),
    ],
)
def test_phone(spark, text, want):
    assert surfaces(spark, text, lambda s: F.concat(*detect.phone_ranges(s))) == want


def test_mynumber(spark):
    body = "31415926535"
    r = sum(int(c) * w for c, w in zip(reversed(body), K.CHECK_WEIGHTS, strict=True)) % 11
    good = body + str(0 if r <= 1 else 11 - r)
    bad = body + str((int(good[-1]) + 1) % 10)
    assert surfaces(spark, f"番号{good}、{bad}、1{good}", detect.mynumber_ranges) == [good]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("営業部高村様", ["高村"]),
        ("皆様へ", []),
        ("お客様へ", []),
        ("担当者様", []),
        ("人事部長", ["人事"]),
        ("ジョン・スミスさん", ["スミス"]),
        ("榊原課長と東雲先生", ["榊原", "東雲"]),
        ("総務課森氏", ["森"]),
    ],
)
def test_person(spark, text, want):
    assert surfaces(spark, text, detect.person_ranges) == want


def test_organisations(spark):
    assert surfaces(spark, "本日、株式会社ハルカゼ商会へ", detect.org_prefix_ranges) == ["株式会社ハルカゼ商会"]
    assert surfaces(spark, "先方はハルカゼ商会㈱です", detect.org_suffix_ranges) == ["ハルカゼ商会(株)"]
    assert surfaces(spark, "ハルカゼ商会御中", detect.org_honorific_ranges) == ["ハルカゼ商会"]
    assert surfaces(spark, "一般社団法人ミライ会", detect.org_prefix_ranges) == ["一般社団法人ミライ会"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("〒123-4567", ["〒123-4567"]), ("〒 123−4567", ["〒 123−4567"]), ("123-4567", [])],
)
def test_postal(spark, text, want):
    assert surfaces(spark, text, detect.postal_ranges) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("東京都青葉区旭町1-2-3にて", ["東京都青葉区旭町1-2-3"]), ("北海道の気候", []), ("東京都市部の人口", []), ("大阪府青葉市の", ["大阪府青葉市"]), ("京都府", [])],
)
def test_address(spark, text, want):
    assert surfaces(spark, text, detect.address_ranges) == want


# ---- dictionary ------------------------------------------------------------------------------------------------------------


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text('type,name,aliases\nPERSON, 青柳 ,\n,株式会社ハルカゼ, ハル | |春風 \nNONE,"二,三",x\n,,y\n', encoding="utf-8")
    rows = {r.name: (r.type, r.aliases) for r in dictionary.read_csv(spark, str(tmp_path / "d.csv")).collect()}
    assert rows == {"青柳": ("PERSON", []), "株式会社ハルカゼ": ("ORGANIZATION", ["ハル", "春風"]), "二,三": ("ORGANIZATION", ["x"])}
    both = dictionary.read_both(spark, str(tmp_path / "absent.csv"), str(tmp_path / "d.csv"))
    assert {r.type for r in both.collect()} == {"PERSON"}
    keys = dict(dictionary.collect_keys(dictionary.read_csv(spark, str(tmp_path / "d.csv"))))
    assert keys["(株)ハルカゼ"] == "ORGANIZATION" and "ハルカゼ有限会社" in keys and "ハルカゼ" in keys


def test_dictionary_short_cores_and_first_type(spark):
    d = spark.createDataFrame([(0, "株式会社アオ", "ORGANIZATION", []), (1, "重複名称", "PERSON", []), (2, "重複名称", "ORGANIZATION", ["重複 名称"])], "ord int, name string, type string, aliases array<string>")
    keys = dict(dictionary.collect_keys(d))
    assert "アオ" not in keys and "株式会社アオ" in keys and keys["重複名称"] == "PERSON"


def dictionary_plan(*keys):
    return P.Plan(("denylist",), keys=keys)


@pytest.mark.parametrize("literal_keys", [500, 0])
def test_dictionary_hits(spark, monkeypatch, literal_keys):
    monkeypatch.setattr(P, "LITERAL_KEYS", literal_keys)
    plan = dictionary_plan(("アオヤマ", K.ORGANIZATION), ("アオ", K.PERSON), ("aa", K.PERSON), ("x-y", K.PERSON))
    text = "ア オ\nヤマ ａaA aaa x−y ㈱アオヤマ工"
    rows = plan.spans(spark.createDataFrame([(text,)], "text string")).collect()[0].spans
    got = [(text[s.start : s.end], s.type) for s in rows]
    assert got == [("ア オ", "PERSON"), ("ア オ\nヤマ", "ORGANIZATION"), ("ａa", "PERSON"), ("aa", "PERSON"), ("aa", "PERSON"), ("x−y", "PERSON"), ("アオ", "PERSON"), ("アオヤマ", "ORGANIZATION")]


# ---- merging ----------------------------------------------------------------------------------------------------------------


def spans_of(spark, text, *found):
    rows = [(a, b, k, 1.0, list(s)) for a, b, k, *s in found]
    df = spark.createDataFrame([(text, rows)], f"text string, spans {K.SPANS}")
    return [(text[s.start : s.end], s.type, tuple(s.sources)) for s in merge.merge_spans(df).collect()[0].spans]


def test_merge_takes_the_strongest_type(spark):
    got = spans_of(spark, "青柳商会です", (0, 4, K.PERSON, "ner"), (0, 2, K.ORGANIZATION, "denylist"))
    assert got == [("青柳商会", K.ORGANIZATION, ("ner", "denylist"))]


def test_touching_spans_stay_apart(spark):
    assert len(spans_of(spark, "青柳東雲", (0, 2, K.PERSON, "ner"), (2, 4, K.PERSON, "ner"))) == 2


def test_legal_forms_are_taken_in(spark):
    assert spans_of(spark, "ハルカゼ株式会社", (0, 4, K.ORGANIZATION, "denylist"))[0][0] == "ハルカゼ株式会社"
    assert spans_of(spark, "㈱ハルカゼ", (1, 5, K.ORGANIZATION, "denylist"))[0][0] == "ハルカゼ"


def test_spread(spark):
    got = spans_of(spark, "株式会社ハルカゼ商会。ハルカゼ商会は、ハルカゼ商会ビルの、ﾊﾙｶｾﾞ", (0, 10, K.ORGANIZATION, "structural"))
    assert [g[0] for g in got] == ["株式会社ハルカゼ商会", "ハルカゼ商会"] and got[1][2] == ("structural", "propagation")
    assert [g[0] for g in spans_of(spark, "ＡＣＭＥとACMEと", (0, 4, K.ORGANIZATION, "ner"))] == ["ＡＣＭＥ", "ACME"]
    assert [g[0] for g in spans_of(spark, "東と東の", (0, 1, K.PERSON, "ner"))] == ["東"]
    assert [g[0] for g in spans_of(spark, "株式会社アオ、アオ", (0, 6, K.ORGANIZATION, "ner"))] == ["株式会社アオ"]
    assert [g[0] for g in spans_of(spark, "ハルカゼと(株)ハルカゼ", (0, 4, K.ORGANIZATION, "ner"))] == ["ハルカゼ", "(株)ハルカゼ"]
    assert [g[0] for g in spans_of(spark, "ハルカゼと株式会社ハルカゼ", (0, 4, K.ORGANIZATION, "ner"))] == ["ハルカゼ"]


# ---- masking -----------------------------------------------------------------------------------------------------------------


def masked(spark, text, *found):
    rows = [(a, b, k, 1.0, ["stub"]) for a, b, k in found]
    return M.mask(spark.createDataFrame([(text, rows)], f"text string, spans {K.SPANS}")).collect()[0]


def test_same_surface_same_number(spark):
    r = masked(spark, "青柳と東雲と青柳", (0, 2, K.PERSON), (3, 5, K.PERSON), (6, 8, K.PERSON), (0, 2, K.PERSON))
    assert r.masked_text == "[[人名_1]]と[[人名_2]]と[[人名_1]]"
    assert r.mapping == {"[[人名_1]]": "青柳", "[[人名_2]]": "東雲"}


def test_numbers_in_the_text_are_skipped(spark):
    text = "[[人名_1]]と[人名 ３]と【人名_02】と[組織_2] 青柳と東雲"
    a, b = text.index("青柳"), text.index("東雲")
    r = masked(spark, text, (a, a + 2, K.PERSON), (b, b + 2, K.PERSON))
    assert r.masked_text.endswith("[[人名_2]]と[[人名_4]]")


def test_overlaps_are_refused_without_text(spark):
    for second in ((1, 3, K.PERSON), (0, 2, K.ORGANIZATION)):
        with pytest.raises(Exception, match="overlapping spans") as e:
            masked(spark, "秘密の名前", (0, 2, K.PERSON), second)
        assert "秘密" not in str(e.value).split("SQLSTATE")[0]


def restored(spark, text, mapping):
    r = U.unmask(spark.createDataFrame([(text, mapping)], "masked_text string, mapping map<string,string>")).collect()[0]
    return r.restored, r.warnings, r.unresolved


@pytest.mark.parametrize("form", ["[人名_1]", "【人名_1】", "[[人名 _1]]", "[[人名 1]]", "[[人名_１]]", "[ 人名_1 ]", "【[人名1]】"])
def test_rewritten_placeholders(spark, form):
    text, warnings, unresolved = restored(spark, f"x{form}y", {"[[人名_1]]": r"青\1柳$0"})
    assert text == r"x青\1柳$0y" and len(warnings) == 1 and not unresolved


def test_restoring_edges(spark):
    assert restored(spark, "[[人名_11]][[人名_1]]", {"[[人名_1]]": "a", "[[人名_11]]": "b"}) == ("ba", [], [])
    text, warnings, unresolved = restored(spark, "[[組織_9]]と[[人名_1]]と[[組織_9]]", {"[[人名_1]]": "a"})
    assert (text, unresolved, len(warnings)) == ("[[組織_9]]とaと[[組織_9]]", ["[[組織_9]]"], 1)
    assert restored(spark, "普通の文", {}) == ("普通の文", [], [])
    with pytest.raises(Exception, match="not a canonical placeholder"):
        restored(spark, "x", {"人名1": "a"})


ALPHABET = st.sampled_from(list("青柳東雲人名組織あいアイ[]【】_ 1１2\n"))


def test_round_trip_of_random_texts(spark):
    cases = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(ALPHABET, max_size=120), st.lists(st.tuples(st.integers(0, 119), st.integers(1, 8), st.sampled_from(K.TYPES)), max_size=4))
    def collect(text, picks):
        taken, spans = [], []
        for at, n, kind in picks:
            word = text[at : at + n]
            i = text.find(word) if word else -1
            while i >= 0 and word:
                if all(i >= b or i + len(word) <= a for a, b in taken):
                    taken.append((i, i + len(word)))
                    spans.append((i, i + len(word), kind, 1.0, ["stub"]))
                i = text.find(word, i + 1)
        cases.append((len(cases), text, spans))

    collect()
    df = U.unmask(M.mask(spark.createDataFrame(cases, f"i int, text string, spans {K.SPANS}")))
    for r in df.select("text", "restored", "mapping", "masked_text", "spans").collect():
        assert r.restored == r.text
        assert len(set(r.mapping)) == len({(s.type, r.text[s.start : s.end]) for s in r.spans})


# ---- scalars -----------------------------------------------------------------------------------------------------------------


def test_legal_form(spark):
    for name, want in (("株式会社アオバ", ("株式会社", "アオバ")), ("アオバ(株)", ("(株)", "アオバ")), ("アオバ", (None, "アオバ")), ("㈱アオバ", (None, "㈱アオバ")), ("株式会社アオバ有限会社", ("株式会社", "アオバ有限会社")), ("NPO法人", ("NPO法人", ""))):
        assert tuple(one(spark, name, S.legal_form)) == want


def test_chunks(spark):
    text = ("短い文。" * 80) + "x" * 300 + "\n終"
    got = one(spark, text, lambda c: S.chunks(c, 100))
    assert "".join(c.chunk for c in got) == text and all(text[c.offset :].startswith(c.chunk) for c in got)
    assert max(len(c.chunk) for c in got) == 301 and all(len(c.chunk) <= 200 for c in got if "x" not in c.chunk)


def test_model_answers(spark):
    take = lambda a: [(i.text, i.type) for i in one(spark, a, S.additions)]
    assert take('{"additions":[{"text":" 青柳 ","type":"PERSON"},{"surface":"アオバ"},7,{"type":"x"},"s"]}') == [("青柳", "PERSON"), ("アオバ", None)]
    assert take('[{"text":"a"}]') == [("a", None)]
    for bad in ("", "null", "5", '"x"', "{", '{"additions":5}', "not json"):
        assert take(bad) == []


def test_loopback():
    assert S.is_loopback("http://localhost:1") and S.is_loopback("http://127.1.2.3/x") and S.is_loopback("http://[::1]:5")
    assert not (S.is_loopback("http://example.com") or S.is_loopback("http://10.0.0.1") or S.is_loopback("http://localhost.evil.com"))


# ---- additive layers -----------------------------------------------------------------------------------------------------------


def test_recogniser_only_adds(spark):
    text = "  青柳 とオオゾラ"
    df = spark.createDataFrame([(text,), ("bad",), ("",)], "text string")

    def find(t):
        if t == "bad":
            raise RuntimeError("no")
        return [(0, 5, "Person"), (6, 10, "Company"), (0, 1, "City"), (0, 2, "Unknown")]

    rows = {r.text: r.x for r in df.select("text", additive.ner_spans(F.col("text"), find).alias("x")).collect()}
    assert [(text[s.start : s.end], s.type, s.score, s.sources) for s in rows[text]] == [("青柳", "PERSON", 0.5, ["ner"]), ("オオゾラ", "ORGANIZATION", 0.5, ["ner"])]
    assert rows["bad"] == [] and rows[""] == []
    with_missing_model = P.Plan(("regex", "ner"), recogniser="no_such_model").detect(spark.createDataFrame([("a@b.jp 青柳",)], "text string")).collect()[0].spans
    assert len(with_missing_model) == 1


def test_model_layer(spark):
    def client(question):
        assert "マスク済み" in question
        if "壊れる" in question:
            raise TimeoutError
        return '{"additions":[{"text":"オオゾラ企画","type":"ORGANIZATION"},{"text":"無い語"},{"text":"x"}]}'

    texts = ["昨日オオゾラ企画とa@b.jpへ。オオゾラ企画", "壊れる a@b.jp", "", "何もない"]
    plan = P.Plan(("regex",), client=client)
    rows = {r.text: r.spans for r in plan.detect(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert [texts[0][s.start : s.end] for s in rows[texts[0]]] == ["オオゾラ企画", "a@b.jp", "オオゾラ企画"]
    assert [len(rows[t]) for t in texts[1:]] == [1, 0, 0]


def test_endpoints_are_checked_when_a_plan_is_built(spark):
    with pytest.raises(ValueError, match="this machine"):
        P.build(spark, Settings(llm_endpoint="http://example.com"), use_llm=True)
    additive.check_endpoint("http://example.com", allow_remote=True)


# ---- plans -----------------------------------------------------------------------------------------------------------------------


def test_layers(spark):
    cfg = Settings()
    assert P.build(spark, cfg).layers == ("regex", "structural", "denylist")
    assert P.build(spark, cfg, use_address=True, use_ner=True).layers == P.LAYERS
    assert P.without(spark, "regex", config=cfg).layers == ("structural", "denylist")
    for bad in ({"regexx"}, {"ner"}, set()):
        with pytest.raises(ValueError):
            P.build(spark, cfg, layers=bad)
    with pytest.raises(ValueError):
        P.without(spark, "adress", config=cfg)


def test_one_text(spark):
    plan = P.Plan(("regex", "structural"), Settings(extra_patterns=(("案件[0-9]+", K.ORGANIZATION),)))
    made = P.mask_text(spark, "青柳様、案件42、a@b.jp\r\n青柳", plan)
    assert made["masked_text"] == "[[人名_1]]様、[[組織_1]]、[[メール_1]]\r\n[[人名_1]]"
    assert P.unmask_text(spark, made["masked_text"], made["mapping"])["text"] == "青柳様、案件42、a@b.jp\r\n青柳"


def test_null_and_plain_texts(spark):
    rows = P.mask(spark.createDataFrame([(1, None), (2, "plain")], "doc_id long, text string"), P.Plan(P.BASE)).orderBy("doc_id").collect()
    assert [(r.masked_text, r.mapping, r.report) for r in rows] == [("", {}, []), ("plain", {}, [])]


def test_no_shuffle_and_no_python_in_a_plan(spark):
    df = P.mask(spark.createDataFrame([(1, "a@b.jp")], "doc_id long, text string"), P.Plan(("regex", "structural", "denylist", "address"), keys=(("アオヤマ", K.ORGANIZATION),)))
    plan = df.select("masked_text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
