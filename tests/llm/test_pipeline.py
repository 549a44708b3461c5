import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import common as C
from sparkveil.llm import jaccard
from sparkveil.llm.simhash import stage_simhash


def low(t):
    return (t or "").encode().lower()


def test_stages(spark, docs, scratch):
    """One after another. Plain versions of the decisions: of language ID and mixing in test_others, of near-dedup below,
    of exact dedup and tokens here."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    at = docs
    for name, stage in P.STAGES[:-1]:
        before = at.collect()
        at = scratch.keep(stage(spark, at, ""), name)
        after = at.collect()
        assert at.columns == docs.columns
        assert not set(map(str, after)) - set(map(str, before))
        if name == "exact_dedup":
            assert Counter(low(r.text) for r in after) == Counter({low(r.text): 1 for r in before})
    out = P.STAGES[-1][1](spark, at, "").collect()
    assert len(out) == at.count() and all(r.decoded_equal for r in out)
    want = Counter((r.doc_id, tuple(library.encode(r.text))) for r in at.collect() if len(r.text) < 10_000)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out if (r.doc_id, tuple(r.ids)) in want) == want


def test_run_on_tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    out = P.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in out} <= set(docs) and all(r.decoded_equal and r.n_ids == len(r.ids) for r in out)
    kept = {low(docs[r.doc_id].text) for r in out}
    assert len({r.doc_id for r in out}) == len(kept)  # no two equal texts


def test_run_leaves_only_what_its_last_stage_reads(spark):
    from pathlib import Path

    root = Path(C.shared_dir(spark).removeprefix("file://"))
    there = set(root.iterdir())
    out = P.run(spark, "/root/testdata/sf0.001")
    left = [p.name for new in set(root.iterdir()) - there for p in new.iterdir()]
    assert [n for n in left if n.endswith("-mixing")] and not [n for n in left if n.endswith(("-language_id", "-exact_dedup", "-simhash_near_dedup", "-sets", "-prints"))]
    assert out.count()


def test_near_dedup_keeps_one_of_each_group(spark, docs, tmp_path, scratch):
    """Against all pairs: near copies of five-word similarity 0.8 or more go, in a group larger than jaccard.REACH too."""
    r = random.Random(8)
    say = lambda n: [r.choice("bcdfghjk") + r.choice("aeiou") + r.choice("lmnprst") + r.choice("aeiou") for _ in range(n)]
    texts = []
    for group in (*[2] * 12, 40):
        base = say(100)
        for _ in range(group):
            w = list(base)
            for at in r.sample(range(100), r.randint(0, 3)):
                w[at] = say(1)[0]
            texts.append(" ".join(w))
    passage = " ".join(say(30))  # what many unlike texts share lies in their prefixes, as they have little else
    shared = [f"{passage} {' '.join(say(r.randint(6, 12)))}" for _ in range(25)]
    texts += shared + [t + " " + say(1)[0] for t in shared[:10]]
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), " ".join(say(3)), "a b c", "A  b\tc", "a b d"]
    path = f"file://{tmp_path}/near.parquet"
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    docs.unionByName(more, allowMissingColumns=True).repartition(5).write.parquet(path)
    rows = spark.read.parquet(path).collect()
    words = [low(x.text).split() for x in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    for bounds in ({}, {"part": 4, "block": 5}):  # whole buckets, and large ones in parts and blocks
        got = jaccard.near_duplicates(C.with_row_id(spark.read.parquet(path).select("doc_id", "text"), scratch), scratch, **bounds).collect()
        assert len(got) == len(rows) and len({g.keep_row for g in got}) == len(set(root))
    least = {}
    for i, x in enumerate(rows):
        at = (x.doc_id is None, x.doc_id)
        least[root[i]] = min(least.get(root[i], (True, None)), at, key=lambda v: (v[0], v[1] or 0))
    kept = stage_simhash(spark, spark.read.parquet(path), "").collect()
    assert sorted(map(str, (x.doc_id for x in kept))) == sorted(str(v[1]) for v in least.values())
    where = {str(tuple(x)): root[i] for i, x in enumerate(rows)}
    assert Counter(where[str(tuple(x))] for x in kept) == Counter(set(root))


def test_bitmaps_never_rule_out_what_is_similar():
    """Bits that differ are no more than the shingles of one set only, for bitmaps of any two lengths."""
    rng = np.random.default_rng(5)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (60, 70, 50), (900, 1100, 880), (5000, 300, 200), (3000, 3000, 0)):
        x = rng.choice(1 << 62, n + m - both, replace=False).astype(np.uint64) if n + m else np.zeros(0, np.uint64)
        a, b = x[:n], x[n - both :]
        d = jaccard.apart(jaccard.wide(a), jaccard.wide(b))
        assert d <= n + m - 2 * both and d == jaccard.apart(jaccard.wide(b), jaccard.wide(a))
    assert d > 1500


def test_no_tile_holds_a_large_bucket(spark, scratch):
    """A bucket of one group gives no tile; of others each pair of members meets, and no tile has far more than two blocks."""
    rows = [(1, 50, i, 0, 7) for i in range(300)] + [(2, 50, i, 0, i % 3) for i in range(400)] + [(3, 50, i, 0, i) for i in range(5)]
    members = spark.createDataFrame(rows, "sh long, n int, node long, pos int, root long")
    by = {}
    for t in jaccard.tiles(members, scratch, len(rows), 20).collect():
        by.setdefault(t.tile, []).append((t.node, t.block))
    assert max(map(len, by.values())) <= 80
    met = {(a, b) for t in by.values() for a, x in t for b, y in t if a < b and (x != y or len({k for _, k in t}) == 1)}
    assert met == {(a, b) for b in range(400) for a in range(b)}
