"""The near-dedup stage links by SimHash first."""

import random

import numpy as np

from sparkveil.llm import graph, jaccard, simhash


def test_stage_links_by_simhash(spark, tmp_path, monkeypatch):
    """Fingerprints are of five words; what they link is checked and then one group to the exact rounds."""
    r = random.Random(2)
    base = [r.choice("bcdfg") + r.choice("aeiou") + str(r.randint(0, 99)) for _ in range(4000)]
    near = [base[:i] + ["x"] + base[i + 1 :] for i in (5, 2000, 3990)]  # long texts: one word moves few bits
    texts = [" ".join(t) for t in (base, *near, base[:40], base[100:140])]
    path = f"file://{tmp_path}/docs.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    seen, own = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda prints, scratch: seen.append(own(prints, scratch)) or seen[-1])
    kept = simhash.stage_simhash(spark, spark.read.parquet(path), "").collect()
    assert sorted(x.doc_id for x in kept) == [0, 4, 5]
    name = {jaccard.node(jaccard.shingles(t.encode())): i for i, t in enumerate(texts)}
    prints = [simhash.of_set(jaccard.shingles(t.encode())) for t in texts]
    want = {frozenset((i, j)) for i in range(6) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.MOST}
    got = {frozenset((name[a], name[b])) for a, b in seen[0].collect()}
    assert got and got <= want


def test_alike_spans_what_fingerprints_link(spark, scratch):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 62, 30).tolist()
    fps = [c ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 3), replace=False)) for c in centres for _ in range(12)]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "node long, fp long")
    links = simhash.alike(prints, scratch)
    assert all((fps[a] ^ fps[b]).bit_count() <= simhash.MOST for a, b in links.collect())
    got = {r.node: r.root for r in graph.components(links, scratch).collect()}
    root = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= simhash.MOST:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert [got.get(i, i) for i in range(len(fps))] == root


def test_fingerprint_of_a_set(spark):
    found = jaccard.shingles(b"a b c d e f g h")
    bits = [sum(int(h) >> b & 1 for h in found) * 2 > len(found) for b in range(64)]
    assert simhash.of_set(found) == sum(1 << b for b, on in enumerate(bits) if on)
    assert simhash.of_set(found[:0]) == 0
