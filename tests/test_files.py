import os
import stat

import pytest
from pyspark.sql import functions as F

from sparkveil.__main__ import main
from sparkveil.operators import mask as M
from sparkveil.plans import pipeline as P
from sparkveil.sources import documents, mappings, review, settings
from sparkveil.streaming import mask_stream


def test_bytes_stay(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("一行\r\n二行\n".encode())
    assert documents.read_input(spark, str(tmp_path / "a.txt")).collect()[0].text == "一行\r\n二行\n"
    documents.write_output("x\r\ny", str(tmp_path / "b.txt"))
    assert (tmp_path / "b.txt").read_bytes() == b"x\r\ny"


def test_output_ends_its_line(capsys):
    for text, want in (("x", "x\n"), ("x\n", "x\n"), ("", "")):
        documents.write_output(text, None)
        assert capsys.readouterr().out == want


def test_mapping_file(spark, tmp_path):
    path = str(tmp_path / "secret" / "m.json")
    held = {"[[人名_1]]": "青柳"}
    mappings.save(spark, held, path)
    assert mappings.load(spark, path) == held and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    os.chmod(path, 0o644)
    mappings.save(spark, held, path, "pass")
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600 and "青柳" not in open(path, encoding="utf-8").read()
    assert mappings.load(spark, path, "pass") == held
    for wrong in ("other", None, ""):
        with pytest.raises(ValueError):
            mappings.load(spark, path, wrong)
    with pytest.raises(ValueError):
        mappings.seal(spark, held, "")
    mappings.forget(path)
    mappings.forget(path)
    assert not os.path.exists(path)


def test_mapping_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "[[人名_1]]", "青柳"), (2, 0, "[[人名_1]]", "東雲")], mappings.SCHEMA)
    for passphrase in (None, "pass"):
        path = str(tmp_path / f"t{passphrase}")
        mappings.write_table(rows, path, passphrase)
        assert sorted(r.original for r in mappings.read_table(spark, path, passphrase).collect()) == ["東雲", "青柳"]
    assert "original" not in spark.read.parquet(str(tmp_path / "tpass")).columns
    with pytest.raises(ValueError):
        mappings.read_table(spark, str(tmp_path / "tpass"))
    with pytest.raises(Exception, match="can't be opened"):
        mappings.read_table(spark, str(tmp_path / "tpass"), "other").collect()
    mappings.wipe(spark, str(tmp_path / "tpass"))
    mappings.wipe(spark, str(tmp_path / "tpass"))


def test_review_page(spark):
    df = spark.createDataFrame([("<b>青柳様 a@b.jp</b>",), ("何もない",)], "text string")
    pages = review.pages(P.mask(df, P.Plan(("regex", "structural"))), "text").collect()
    page = next(p.html for p in pages if "青柳" in p.text)
    assert "<b>" not in page and "&lt;b&gt;" in page and page.count("<mark ") == 2
    assert 'title="元: 青柳 / 型: 人名 / 根拠: structural"' in page and "2 件" in page
    assert "（検出なし）" in next(p.html for p in pages if "何も" in p.text)


def test_review_page_leaves_digits_alone(spark):
    df = spark.createDataFrame([("0120 青柳様 10 東雲様 01",)], "text string")
    html = review.pages(P.mask(df, P.Plan(("structural",))), "text").collect()[0].html
    body = html.partition("テキスト</h2><pre>")[2].partition("</pre>")[0]
    assert body.startswith("0120 <mark") and " 10 <mark" in body and body.endswith(" 01") and body.count("<mark ") == 2


def test_report(spark):
    said = P.mask(spark.createDataFrame([("青柳様",)], "text string"), P.Plan(("structural",))).select(M.report_text(F.col("report")).alias("r")).collect()[0].r
    assert said.split("\n")[:2] == ["=== マスク結果: 1 件 ===", "  [[人名_1]]      人名      青柳   <- structural"]


def test_settings(tmp_path):
    path = str(tmp_path / "conf" / "config.yaml")
    assert settings.load(path) == settings.Settings()
    assert settings.ensure_file(path) and not settings.ensure_file(path)
    got = settings.load(path)
    assert (got.person_max, got.min_core, got.llm_enabled) == (4, 3, False)
    for odd in (None, [], "x", {"structural": 5}):
        assert settings.from_dict(odd) == settings.Settings()
    assert settings.from_dict({"regex": {"extra_patterns": [{"pattern": "x+", "type": "PHONE"}, {"pattern": "y", "type": "?"}, {"type": "PHONE"}]}}).extra_patterns == (("x+", "PHONE"),)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("SPARKVEIL_PASSPHRASE", raising=False)
    (tmp_path / "in.txt").write_bytes("青柳様\r\na@b.jp".encode())
    assert main(["mask", "in.txt", "--out", "out.txt", "--no-ner", "--html", "page.html"], spark) == 0
    assert (tmp_path / "out.txt").read_bytes() == "[[人名_1]]様\r\n[[メール_1]]".encode()
    assert "マスク結果: 2 件" in capsys.readouterr().err and stat.S_IMODE(os.stat("page.html").st_mode) == 0o600
    assert main(["unmask", "out.txt", "--out", "back.txt"], spark) == 0
    assert (tmp_path / "back.txt").read_bytes() == (tmp_path / "in.txt").read_bytes()
    (tmp_path / "reply.txt").write_text("[[組織_7]]", encoding="utf-8")
    assert main(["unmask", "reply.txt"], spark) == 1
    assert main(["mask", "in.txt", "--encrypt", "--no-ner"], spark) == 2
    assert main(["wipe"], spark) == 0 and main(["unmask", "out.txt"], spark) == 2


def test_stream_equals_batch(spark, tmp_path):
    docs = [(i, f"青柳{'様' if i % 2 else 'さん'} {i} a{i}@b.jp 株式会社ハルカゼ{i}、ハルカゼ{i}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    plan = P.Plan(("regex", "structural", "denylist"), keys=(("アオヤマ", "ORGANIZATION"),))
    stream = mask_stream.mask_stream(mask_stream.read(spark, str(tmp_path / "in")), plan)
    query = mask_stream.write(stream, str(tmp_path / "texts"), str(tmp_path / "maps"), str(tmp_path / "check"))
    assert query.awaitTermination(120) and query.exception() is None
    batch = P.mask(frame, plan)
    got = {r.doc_id: r.masked_text for r in spark.read.parquet(str(tmp_path / "texts")).collect()}
    assert got == {r.doc_id: r.masked_text for r in batch.select("doc_id", "masked_text").collect()}
    pairs = {(r.doc_id, r.token, r.original) for r in spark.read.parquet(str(tmp_path / "maps")).collect()}
    assert pairs == {(r.doc_id, r.token, r.original) for r in M.mapping_rows(batch).collect()}
