import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkveil.llm import common as C
from sparkveil.llm import language_id, licenses, mixing, sharding, warc
from sparkveil.llm import sentencepiece_stream as spm

# ---- WARC --------------------------------------------------------------------------------------------------------------


def page_rows():
    big, other = "<p>" + "copy " * 300 + "</p>", "<i>" + "ünïcode " * 200 + "</i>"
    rows = [(i, f"http://x/{i} ü", f"<html>{i} " + "words and more words " * (i % 60) + "</html>") for i in range(120)]
    rows += [(200 + i, "http://y", big) for i in range(50)] + [(300, None, other), (301, "", other), (301, "", other), (None, "u", other)]
    return rows + [(400, "a", None), (401, "a", None), (402, "a", ""), (403, "a", "short"), (404, "a", "short"), (405, "line\r\nbreak", "x" * 3_000_000)]


def test_warc_round_trip(spark, scratch, tmp_path, monkeypatch):
    rows = page_rows()
    path = f"file://{tmp_path}/pages.parquet"
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3).write.parquet(path)
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    archives = warc.archive_pages(pages, f"{scratch.path}/warc", scratch)
    got = warc.read_archives(archives, f"{scratch.path}/warc").collect()
    last = {}
    for page, _, html in rows:
        if html and len(html.encode()) >= 1000 and page is not None:
            last[html] = max(last.get(html, page), page)
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        of = last.get(html) if page is not None else None
        revisit = of is not None and page < of
        want[(page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", of if revisit else None)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert archives.agg({"n_records": "sum"}).collect()[0][0] == len(rows)


def test_warc_dictionary_frame():
    records = [warc.build_record(i, f"http://x/{i}", b"<html>" + b"the same words over and over " * 20 + str(i).encode(), "0" * 40, None) for i in range(300)]
    out = io.BytesIO()
    offsets = warc.write_archive(out, records)
    raw = out.getvalue()
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and offsets[0] == 8 + size
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    import zstandard

    trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj().decompress(raw[offsets[7] :])
    assert one == records[7]  # a record is read at its offset alone
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-5])))
    few = io.BytesIO()
    warc.write_archive(few, records[:2])
    assert list(warc.read_archive(io.BytesIO(few.getvalue()))) == records[:2]
    good = warc.build_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"abc", b"abd"))


def test_warc_empty(spark, scratch):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archive_pages(none, f"{scratch.path}/warc", scratch), f"{scratch.path}/warc").count() == 0


# ---- mixing ------------------------------------------------------------------------------------------------------------


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, stopped, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in stopped]
        share = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if w[s] * share > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: w[s] * share for s in open_}
        for s in over:
            stopped.add(s)
            target[s] = float(most * sizes[s])
            left -= target[s]


def slow_mix(rows):
    """Rows sorted by hash and counted one by one."""
    sized = []
    for r in rows:
        key = f"mix:{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}"
        sized.append((r.doc_id, r.source, len((r.text or "").encode().split()), hashlib.md5(key.encode()).hexdigest()))
    sizes = Counter()
    for _, s, n, _ in sized:
        sizes[s] += n
    target = slow_targets(sizes)
    out = Counter()
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        budget, before = target[s] - whole * sizes[s], 0
        groups = defaultdict(list)
        for r in sized:
            if r[1] == s:
                groups[r[3]].append(r)
        for h in sorted(groups):
            n = sum(r[2] for r in groups[h])
            once = before <= budget and before + n / 2 <= budget
            for r in groups[h]:
                out[(r[0], r[2], sizes[s], round(target[s], 6), r[2] * (whole + once))] += 1
            before += n
    return out


@pytest.mark.parametrize("digits", [1, 3])
def test_mixing(docs, scratch, monkeypatch, digits):
    monkeypatch.setattr(mixing, "DIGITS", digits)
    rows = scratch.keep(mixing.sized(docs))
    out = mixing.with_copies(rows, mixing.mix_plan(rows, scratch)).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in out) == slow_mix(docs.collect())
    assert max(r.copies for r in out) <= 3


def test_mixing_targets(spark):
    r = random.Random(2)
    for _ in range(6):
        sizes = {s: r.choice([0, 1, 10, 1000, 50000]) for s in (None, "", "a", "b", "c", "d", "é")}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = slow_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (sizes, got, want)


def test_mixing_stage_and_empty(spark, docs, empty, scratch):
    got = mixing.stage_mixing(spark, docs, "")
    assert got.columns == docs.columns
    want = slow_mix(docs.collect())
    words = Counter()
    for (i, n, _, _, taken), c in want.items():
        if n:
            words[(i, n)] += taken * c
    have = Counter()
    for x in got.collect():
        if n := len((x.text or "").encode().split()):
            have[(x.doc_id, n)] += n
    assert +have == +words
    assert mixing.stage_mixing(spark, empty, "").count() == 0


# ---- sharding ----------------------------------------------------------------------------------------------------------


def slow_place(x, n, seed=sharding.SEED):
    side = 1
    while side * side < n:
        side += 1
    while True:
        left, right = divmod(x, side)
        for k in range(sharding.ROUNDS):
            left, right = right, (left + int(hashlib.md5(f"{right}:{seed + k}".encode()).hexdigest()[:13], 16)) % side
        x = left * side + right
        if x < n:
            return x


def test_sharding(docs, scratch):
    rows = docs.collect()
    got = sharding.shard_rows(docs, 16, scratch).collect()
    key = lambda r: ((r.doc_id is not None, r.doc_id or 0), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1)
    want = Counter()
    for n, r in enumerate(sorted(rows, key=key)):
        p = slow_place(n, len(rows))
        want[(r.doc_id, key(r)[2], key(r)[1], p % 16, p // 16)] += 1
    assert Counter(tuple(r) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    assert Counter(tuple(r) for r in sharding.shard_rows(docs.repartition(7), 16, scratch).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 99, 1000])
def test_permutation(spark, n, monkeypatch):
    monkeypatch.setattr(sharding, "WALKS", 1)
    got = sorted(r._p for r in sharding.permuted(spark.range(n).withColumnRenamed("id", "_n"), n).collect())
    assert got == list(range(n))


def test_sharding_empty(empty, scratch):
    assert sharding.shard_rows(empty, 16, scratch).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(empty, 0, scratch)


# ---- language ID -------------------------------------------------------------------------------------------------------


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(got) == docs.count() and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark, docs, empty, scratch):
    model = language_id.train(docs.select("doc_id", "text", "lang"), scratch)
    assert model["langs"] == ["en", "fr"]
    got = language_id.predict(docs, model).collect()
    assert len(got) == docs.count()
    for r, d in zip(sorted(got, key=str), sorted(docs.select("doc_id", "text").collect(), key=lambda r: str(r.doc_id)), strict=False):
        assert r.lang_pred in ("en", "fr", "und")
    assert language_id.predict_one(None, model) == ("und", 0.0) == language_id.predict_one(" 12 !", model)
    nothing = language_id.train(empty.select("doc_id", "text", "lang"), scratch)
    assert language_id.predict_one("words", nothing) == ("und", 0.0)
    assert language_id.predict(empty, nothing).count() == 0
    kept = language_id.stage_language_id(spark, docs, "")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def slow_counts(text):
    """Character n-grams one by one."""
    out, code = Counter(), [ord(c) if c.isalpha() else 32 for c in text.lower()]
    for n in language_id.ORDERS:
        for i in range(len(code) - n + 1):
            if all(c == 32 for c in code[i : i + n]):
                continue
            h = (code[i] * 0x9E3779B1 + n) % 2**32
            for c in code[i + 1 : i + n]:
                h = ((h ^ h >> 15) * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32
            h = (h ^ h >> 16) * 0x7FEB352D % 2**32
            out[h >> 16] += 1
    return out if any(c != 32 for c in code) else None


def slow_model(rows, per_lang):
    """Frequencies, sample, FTRL-proximal and temperature, by dictionaries and loops. rows: (order, text, lang)."""
    counted = [(o, slow_counts(t or ""), k) for o, t, k in rows if k is not None]
    n_docs = sum(c is not None for _, c, _ in counted)
    df = Counter(d for _, c, _ in counted if c for d in c)
    langs = sorted({k for _, _, k in counted})
    share = {k: min(1.0, per_lang / sum(x == k for _, _, x in counted)) for k in langs}
    sample = sorted({(o, k): c for o, c, k in counted if o % 1_000_003 / 1_000_003.0 < share[k]}.items())
    sample = [(c, langs.index(k)) for (_, k), c in sample if c]
    idf = lambda d: math.log((1 + n_docs) / (1 + df[d])) + 1

    def vector(c):
        x = {d: (1 + math.log(n)) * idf(d) for d, n in c.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {d: v / size for d, v in x.items()} | {-1: 1.0}

    z, g2 = defaultdict(float), defaultdict(float)

    def weight(d, k):
        a = z[d, k]
        if abs(a) <= language_id.L1:
            return 0.0
        return -(a - math.copysign(language_id.L1, a)) / ((language_id.BETA + math.sqrt(g2[d, k])) / language_id.ALPHA + language_id.L2)

    def probabilities(x, t=1.0):
        s = [sum(v * weight(d, k) for d, v in x.items()) / t for k in range(len(langs))]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e], s

    for _ in range(language_id.EPOCHS):
        for i, (c, y) in enumerate(sample):
            if i % 5 == 0:
                continue
            x = vector(c)
            p, _ = probabilities(x)
            for d, v in x.items():
                for k in range(len(langs)):
                    g, w, was = v * (p[k] - (k == y)), weight(d, k), g2[d, k]
                    z[d, k] += g - (math.sqrt(was + g * g) - math.sqrt(was)) / language_id.ALPHA * w
                    g2[d, k] = was + g * g
    held = [(probabilities(vector(c))[1], y) for c, y in sample[::5]]
    wrong = 1 / (len(held) + 2)

    def loss(t):
        total = 0.0
        for s, y in held:
            s = [v / t for v in s]
            top = max(s) + math.log(sum(math.exp(v - max(s)) for v in s))
            total += sum((1 - wrong if k == y else wrong / (len(langs) - 1)) * (top - v) for k, v in enumerate(s))
        return total

    t = min((math.exp(math.log(0.05) + i * (math.log(20) - math.log(0.05)) / 400) for i in range(401)), key=loss) if held and len(langs) > 1 else 1.0
    return lambda text: ("und", 0.0) if (c := slow_counts(text or "")) is None else max(zip(probabilities(vector(c), t)[0], langs, strict=True))[::-1], loss


def test_language_id_against_a_plain_version(spark, scratch):
    """Weights and calibration learned from a sample, number by number."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", F.substring("text", 1, 400).alias("text"))
    rows = docs.select((F.xxhash64(F.lit(6), "doc_id", "text")).alias("o"), "text", "lang").collect()
    model = language_id.train(docs, scratch, per_lang=25)
    slow, loss = slow_model([(r.o, r.text, r.lang) for r in rows], 25)
    best = min(loss(math.exp(math.log(0.05) + i * (math.log(20) - math.log(0.05)) / 400)) for i in range(401))
    assert loss(model["t"]) <= best + 1e-6
    for r in rows[:60]:
        (lang, score), (want, p) = language_id.predict_one(r.text, model), slow(r.text)
        assert lang == want and abs(score - p) < 0.02, (lang, score, want, p)


def test_language_id_counts():
    for text in ("Straße und İstanbul, 12 élan", "a", " b ", "12 !!", "x y z"):
        c, want = language_id.counts(text), slow_counts(text)
        assert (None if c is None else Counter({int(d): int(c[d]) for d in c.nonzero()[0]})) == want


def test_language_id_repeated_rows_bound_the_sample(spark, tmp_path, scratch):
    """A row that comes a thousand times counts once in the sample."""
    path = f"file://{tmp_path}/same.parquet"
    rows = [(None, "the same words again", "en")] * 1000 + [(i, f"d'autres mots {i}", "fr") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    model = language_id.train(spark.read.parquet(path), scratch, per_lang=1000)
    assert model["langs"] == ["en", "fr"] and language_id.predict_one("the words", model)[0] == "en"
    sample = spark.read.parquet(f"{scratch.path}/*-sample")
    assert sample.filter("lang = 'en'").count() == 1


def test_language_stage_against_a_plain_version(spark, docs):
    """The stage keeps what one prediction after another keeps; with nothing to learn from it keeps all."""
    kept = language_id.stage_language_id(spark, docs, "").collect()
    model = language_id.train(docs.select("doc_id", "text", "lang").filter(language_id.fold(F.col("doc_id")) != 2), C.Scratch(spark, "plain"))
    want = []
    for r in docs.collect():
        lang, score = language_id.predict_one(r.text, model)
        if lang != "und" and score >= 1.2 / 2:
            want.append(r)
    assert Counter(map(str, kept)) == Counter(map(str, want)) and 0 < len(want) < docs.count()
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.stage_language_id(spark, nothing, "").count() == docs.count()


def test_windows_count_like_whole_texts(monkeypatch):
    text = "Straße und İstanbul, 12 élan " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "WINDOW", 17)
    assert (language_id.counts(text) == whole).all()


# ---- SentencePiece -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return spm.Coder(spm.load_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def test_ids_equal_those_of_the_library(coder, library):
    r = random.Random(7)
    letters = "abcdethinoaoi eeè\n  .,0123株東京 ЖДда한\t\x00🙂é"
    texts = ["", " ", "  ", "a", " a", "a ", " " * 40, "x" + " " * 33 + "y", "\n\n", "á", "<s>", "<0x41>"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdethinrst") for _ in range(r.randint(100, 700))) for _ in range(60)]
    for t in texts:
        assert coder.encode(t) == library.encode(t), t
        assert coder.decode(coder.encode(t)) == t


def test_streaming_commits_early_and_equals_the_whole(coder):
    unit = spm.SPACE + "internationalisation" * 200
    taken = []
    for p in coder.pieces_of(unit):
        taken.append(p)
    assert "".join(taken) == unit
    whole = [""]  # each back pointer, without a window
    for at in range(1, len(unit) + 1):
        whole.append(None)
        coder._last(unit, at, 0, whole)
    assert taken == coder._path(unit, len(unit), 0, whole)


def test_space_sign_comes_back(coder):
    for t in ("▁", "a▁b", "▁▁ x", " ▁ "):
        assert coder.decode(coder.encode(t)) == t


def test_encode_columns(spark, docs, empty):
    got = spm.encode(docs, check=True)
    rows = got.collect()
    assert all((r.ids is None) == (r.text is None) and r.decoded_equal in (True, None) for r in rows)
    back = spm.decode(got.select("doc_id", "ids"), to="again").collect()
    assert Counter(r.again for r in back) == Counter(r.text for r in rows)
    assert spm.encode(empty).count() == 0
    again = spm.encode(got.withColumnRenamed("doc_id", "x").drop("decoded_equal"))
    assert Counter(map(str, again.select("text", "ids").collect())) == Counter(map(str, got.select("text", "ids").collect()))
    named = spm.encode(docs.select("doc_id", docs.text.alias("ids")), text="ids")
    assert named.columns == ["doc_id", "ids"] and Counter(str(r.ids) for r in named.collect()) == Counter(str(r.ids) for r in rows)
    assert spm.decode(named, to="ids").columns == ["doc_id", "ids"]


# ---- licenses ----------------------------------------------------------------------------------------------------------


def slow_coverage(template, text):
    """Longest common subsequence of words, without a band, in any window of twice the template."""
    a, b = (licenses.words(x.encode())[2].tolist() for x in (template, text))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1] / len(a)


def test_license_scan(spark):
    r = random.Random(3)
    noise = lambda n: " ".join("".join(r.choice("bcdfg") for _ in range(5)) for _ in range(n))
    index = licenses.Index(licenses.TEMPLATES)
    rows = []
    for i, (name, text) in enumerate(x for x in licenses.TEMPLATES.items() if not x[0].endswith("/whole")):
        w = text.split()
        for k in range(3):
            changed = [x for x in w if k == 0 or r.random() > 0.06]
            if k == 2 and len(changed) > 20:
                changed.insert(10, "really")
            rows.append((i * 3 + k, name, f"{noise(30)} é {' '.join(changed).upper() if k == 1 else ' '.join(changed)}\n{noise(20)}", " ".join(changed)))
    for _, name, text, body in rows:
        got = licenses.scan(text.encode(), index)
        want = slow_coverage(licenses.TEMPLATES[name], body)
        if want >= 0.9:
            assert any(g[0].split("/")[0] == name.split("/")[0] for g in got), (name, body, got)
        for g in got:
            assert g[1] <= slow_coverage(licenses.TEMPLATES[g[0]], text) + 1e-9
    assert licenses.scan(noise(500).encode(), index) == []
    out = licenses.scan_licenses(spark.createDataFrame([(1, rows[0][2], "x"), (None, None, "y"), (2, "", "z"), (3, "none", None)], "doc_id long, text string, license string")).collect()
    assert [(o.doc_id, o.template) for o in out] == [(1, rows[0][1])]
    assert rows[0][2][out[0].start : out[0].end] + "." == rows[0][3]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


INDEX = licenses.Index(licenses.TEMPLATES)


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if not n.endswith("/whole")])
@pytest.mark.parametrize("between", ["\n", " bcd dfg ", " bcd" * 9 + " "])
def test_license_notices_again(name, between):
    """Each of several notices one after another has its span: all of them, and no other."""
    line = licenses.TEMPLATES[name].strip()
    size, end = len((line + between).encode()), len(line.rstrip('.!"/').encode())
    for times in (1, 2, 3, 7, 50):
        got = licenses.scan(between.join([line] * times).encode(), INDEX)
        assert [(g[0], g[1], g[3], g[4]) for g in got] == [(name, 1.0, i * size, i * size + end) for i in range(times)]


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES if n.endswith("/whole")])
def test_whole_licenses(name):
    """A license among other words, twice, the second time with words changed and left out."""
    r = random.Random(4)
    noise = lambda n: " ".join("".join(r.choice("bcdfg") for _ in range(5)) for _ in range(n))
    text = licenses.TEMPLATES[name].strip()
    changed = [w if r.random() > 0.02 else "bcdfg" for w in text.split() if r.random() > 0.01]
    raw = f"{noise(300)}\n{text}\n{noise(200)}\n{' '.join(changed)}\n{noise(90)}".encode()
    got = [g for g in licenses.scan(raw, INDEX) if g[2] > 300]
    assert [g[0] for g in got] == [name, name] and got[0][1] == 1.0 and got[1][1] > 0.9
    spans = [raw[g[3] : g[4]].decode() for g in got]
    assert licenses.words(spans[0].encode())[2].tolist() == INDEX.words[INDEX.names.index(name)].tolist()
    assert abs(len(spans[1]) - len(" ".join(changed))) < 200
    assert licenses.scan(noise(3000).encode(), INDEX) == []


def test_license_bare_notice():
    """The bare notice counts, and where the longer form stands, that is the one reported."""
    index = licenses.Index(licenses.TEMPLATES)
    got = licenses.scan(b"(c) 2020 bcd. All Rights Reserved.\nAll rights reserved. dfg", index)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [("Proprietary/bare", 1.0, 14, 33), ("Proprietary/bare", 1.0, 35, 54)]
    assert [g[0] for g in licenses.scan(licenses.TEMPLATES["Proprietary/line"].encode(), index)] == ["Proprietary/line"]
    assert licenses.scan(b"all rights were reserved", index) == []


def test_license_pieces(monkeypatch):
    index = licenses.Index(licenses.TEMPLATES)
    text = ("words " * 300 + licenses.TEMPLATES["GPL-3.0/notice"] + " more " * 300 + licenses.TEMPLATES["MIT/line"]).encode()
    whole = licenses.scan(text, index)
    assert [g[0] for g in whole] == ["GPL-3.0/notice", "MIT/line"]
    monkeypatch.setattr(licenses, "PIECE", 700)
    monkeypatch.setattr(licenses, "OVERLAP", 2000)
    assert licenses.scan(text, index) == whole


# ---- shared parts ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_rows_are_named_and_split(spark, docs, scratch, most):
    """In one part and in many, each of which reads files of its own."""
    d = C.with_row_id(docs.select("doc_id", "text"), scratch)
    names = [tuple(r._row) for r in d.collect()]
    assert len(set(names)) == len(names) == docs.count()
    gone = d.filter("doc_id % 3 = 1").select("_row")
    inside, outside = C.split_rows(d, gone, scratch, most)
    assert sorted(tuple(r._row) for r in inside.collect()) == sorted(tuple(r._row) for r in gone.collect())
    assert sorted(tuple(r._row) for r in outside.collect()) == sorted(set(names) - {tuple(r._row) for r in gone.collect()})
    nothing, everything = C.split_rows(d, gone.limit(0), scratch, most)
    assert nothing.count() == 0 and everything.count() == len(names)
    not_a_file = d.groupBy("doc_id").count()
    assert C.with_row_id(not_a_file, scratch).select("_row").distinct().count() == not_a_file.count()


def test_parts_prune_files(spark, docs, scratch):
    d = C.with_row_id(docs.select("doc_id", "text"), scratch)
    inside, _ = C.split_rows(d, d.select("_row"), scratch, 1)
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "metadata" in plan.lower() and inside.count() == d.count()
    reads = C.split_rows(d, d.select("_row"), scratch)[0]
    assert reads.count() == d.count()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        C.shared_dir(Session())


def test_words_of_buffers():
    import numpy as np

    raw = " one two\x0bone  ünï\n".encode()
    buf = np.frombuffer(raw, np.uint8)
    s, e = C.word_bounds(buf)
    assert [raw[a:b] for a, b in zip(s, e, strict=True)] == raw.split()
    h = C.word_hashes(buf, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
    assert len(C.word_hashes(buf[:0], s[:0], e[:0])) == 0
