import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sparkveil.llm import common as C
from sparkveil.llm import embedding_dedup, exact_dedup, graph, simhash, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(t):
    return (t or "").translate(LOWER)


def words(t):
    return (t or "").encode().split()


def with_ids(docs, scratch):
    return C.with_row_id(docs.select("doc_id", "text"), scratch)


@pytest.mark.parametrize("prime", [exact_dedup.PRIME, 5])
def test_exact_dedup(docs, scratch, prime):
    d = with_ids(docs, scratch)
    got = exact_dedup.exact_duplicates(d, scratch, prime).collect()
    source = {r._row: r for r in d.collect()}
    groups = defaultdict(list)
    for r in source.values():
        groups[low(r.text)].append(r)
    assert len(got) == len(source)
    for g in got:
        group = groups[low(source[g._row].text)]
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert g.group_size == len(group) and g.keep_id == (max(ids) if ids else None)
        assert g.text_sha256 == hashlib.sha256(low(source[g._row].text).encode()).hexdigest()
    assert Counter(low(source[g._row].text) for g in got if g.kept) == Counter(dict.fromkeys(groups, 1))


def test_chunk_terms_compose():
    raw = bytes(range(256)) * 700
    for base in exact_dedup.BASES:
        whole = sum((b * pow(base, i, exact_dedup.PRIME)) for i, b in enumerate(raw)) % exact_dedup.PRIME
        parts = sum(exact_dedup.chunk_term(raw[a : a + exact_dedup.CHUNK], a, base) for a in range(0, len(raw), exact_dedup.CHUNK))
        assert parts % exact_dedup.PRIME == whole


def test_exact_dedup_empty_and_stage(spark, docs, empty, scratch):
    assert exact_dedup.exact_duplicates(with_ids(empty, scratch), scratch).count() == 0
    kept = exact_dedup.stage_exact_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(low(r.text) for r in kept.collect()) == Counter(dict.fromkeys({low(r.text) for r in docs.collect()}, 1))


def slow_fingerprint(t):
    w = low(t).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components_of(n, linked):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_simhash(docs, scratch, empty):
    d = with_ids(docs, scratch)
    got = {r._row: r for r in simhash.near_duplicates(d, scratch).collect()}
    rows = d.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    assert all(got[r._row].fp == simhash.signed(p) for r, p in zip(rows, prints, strict=True))
    roots = components_of(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    assert all(got[r._row].component_id == least[root] for r, root in zip(rows, roots, strict=True))
    assert simhash.near_duplicates(with_ids(empty, scratch), scratch).count() == 0


@pytest.mark.parametrize("small", [2, 1024])
def test_pigeonring_misses_no_link(spark, scratch, small):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centres for _ in range(25)}
    fps = sorted(simhash.signed(f) for f in fps)
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), scratch, small)
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links.collect())
    got = {r.node: r.root for r in graph.components(links, scratch).collect()}
    u = [f & (2**64 - 1) for f in fps]
    want = components_of(len(u), lambda i, j: (u[i] ^ u[j]).bit_count() <= 2)
    assert [got.get(f, f) for f in fps] == [fps[w] for w in want]


def test_ring_theorem():
    rng = np.random.default_rng(4)
    for _ in range(500):
        x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))
        assert any(all((x & simhash.ring(s, n)).bit_count() <= n * simhash.MOST / simhash.SEGMENTS for n in range(1, 8)) for s in range(7))
        assert any((x & simhash.ring(s, simhash.EQUAL)) == 0 and (x & simhash.ring(s, simhash.ONE)).bit_count() <= 1 for s in range(7))


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_components_of_a_long_chain(spark, scratch, small):
    edges = [(i, i + 1) for i in range(100)] + [(200, 205), (205, 203), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch, small=small).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 200: 200, 205: 200, 203: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long"), scratch, small=small).count() == 0


def test_roots_of_random_links():
    rng = np.random.default_rng(6)
    for n, m in ((50, 30), (400, 380), (400, 2000)):
        u, v = rng.integers(0, n, (2, m)) * 7 - 90
        node, root = graph.roots_of(u, v)
        index = {x: i for i, x in enumerate(node.tolist())}
        pairs = {frozenset((index[a], index[b])) for a, b in zip(u.tolist(), v.tolist(), strict=True)}
        want = components_of(len(node), lambda i, j: frozenset((i, j)) in pairs)
        assert root.tolist() == [int(node[w]) for w in want]


def slow_substrings(rows, size):
    first = {}
    for r in rows:
        w, key = words(r.text), float("inf") if r.doc_id is None else r.doc_id
        for i in range(len(w) - size + 1):
            s = tuple(w[i : i + size])
            first[s] = min(first.get(s, key), key)
    out = Counter()
    for r in rows:
        w, key = words(r.text), float("inf") if r.doc_id is None else r.doc_id
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key:
                gone.update(range(i, i + size))
        out[(r.doc_id, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("size", "batches", "buckets"), [(13, 4, 3), (3, 6, 5), (13, 1, 1)])
def test_substring_dedup(docs, scratch, size, batches, buckets):
    got = substring_dedup.remove_repeats(docs, scratch, size, batches, buckets)
    assert Counter(tuple(r) for r in got.collect()) == slow_substrings(docs.collect(), size)


@pytest.mark.parametrize("mask", [0xFF, 0xFFF])
def test_substring_collisions_hide_nothing(docs, scratch, mask):
    """Hashes of 8 or 12 bits collide all the time; the result is that of whole hashes."""
    got = substring_dedup.remove_repeats(docs, scratch, 13, 2, 2, mask=mask)
    assert Counter(tuple(r) for r in got.collect()) == slow_substrings(docs.collect(), 13)


def test_substring_index_goes_on(spark, docs, scratch, monkeypatch):
    """Documents that come in three calls, each opening the index anew, give the result of one call."""
    monkeypatch.setattr(substring_dedup, "GROUP", 50)
    rows = docs.filter("doc_id is not null")
    ids = sorted(r.doc_id for r in rows.select("doc_id").collect())
    cuts = [ids[0] - 1, ids[len(ids) // 3], ids[2 * len(ids) // 3], ids[-1]]
    got, folder = Counter(), f"{scratch.path}/kept-index"
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        new, old = rows.filter(f"doc_id > {lo} AND doc_id <= {hi}"), rows.filter(f"doc_id <= {lo}")
        index = substring_dedup.WindowIndex(spark, folder, 5)
        got.update(tuple(r) for r in substring_dedup.remove_repeats(new, scratch, batches=2, index=index, history=old).collect())
    assert got == slow_substrings(rows.collect(), 13)
    again = substring_dedup.WindowIndex(spark, folder)
    assert again.buckets == 5 and len(again.state["runs"]) <= substring_dedup.MOST_RUNS
    with pytest.raises(ValueError, match="order"):
        again.add(rows.withColumn("_doc", rows.doc_id), scratch)
    with pytest.raises(ValueError, match="words"):
        substring_dedup.WindowIndex(spark, folder, size=5)


def test_substring_rows_of_a_slice_are_bounded(spark, scratch):
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(60_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], names=["_doc", "text"])
    index = substring_dedup.WindowIndex(spark, f"{scratch.path}/wide", 250_000)
    assert index.buckets == substring_dedup.MOST_BUCKETS
    rows = sum(b.num_rows for b in substring_dedup._slice_windows(13, ~0, index.buckets)([batch]))
    assert rows <= index.buckets


def test_substring_streams_merge():
    rng = np.random.default_rng(9)
    for sizes in ((0, 7), (100, 1), (50, 90), (0, 0)):
        parts = [np.sort(rng.choice(10_000, n, replace=False)) for n in sizes]
        streams = [[(p[i : i + 8], p[i : i + 8] + 1) for i in range(0, len(p), 8)] for p in parts]
        got = list(substring_dedup._merged(*streams))
        h = np.concatenate([g[0] for g in got]) if got else np.zeros(0, int)
        assert h.tolist() == sorted(np.concatenate(parts).tolist()) and all((d == g + 1).all() for g, d in got)


def test_substring_pieces_and_empty(empty, scratch, monkeypatch):
    raw = (" ".join(f"w{i % 97}" for i in range(5000))).encode()
    whole = substring_dedup.all_hashes(raw, 0)
    monkeypatch.setattr(substring_dedup, "PIECE", 50)
    assert (substring_dedup.all_hashes(raw, 0) == whole).all()
    assert substring_dedup.remove_repeats(empty, scratch).count() == 0


def test_embeddings(spark, scratch, tmp_path):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    vectors = [(base[i % 40] + rng.normal(size=16) * (0.02 if i % 3 else 0.08)).astype(np.float32).tolist() for i in range(300)]
    rows = [(i, v, None if i % 37 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(400 + i, vectors[5], 2) for i in range(60)]  # one vector, many times
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, [float("inf")] + [0.0] * 15, 1), (505, [], 1), (506, [1.0], 1), (507, [2.0], 1), (508, [1e-38] * 16, 1), (509, [1e38] * 16, 1), (7, vectors[7], 1)]
    path = f"file://{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(path)
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.read.parquet(path), scratch, block_values=16 * 16).collect())
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]

    def usable(r):
        return r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    def linked(i, j):
        a, b = rows[i], rows[j]
        if not (usable(a) and usable(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98

    roots = components_of(len(rows), linked)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((r[0], sum(linked(i, j) for j in range(len(rows)) if j != i), least[roots[i]], r[0] == least[roots[i]]) for i, r in enumerate(rows))
    assert got == want
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), scratch).count() == 0


def test_int8_bound_is_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 48))
    x[100:] = x[:100] + rng.normal(size=(100, 48)) * 0.2
    linked, full = embedding_dedup.tile_links(x, x, 0.9)
    n = np.linalg.norm(x, axis=1)
    assert (linked == (x @ x.T / np.outer(n, n) >= 0.9)).all()
    assert full < 0.2 * linked.size
    wide = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (embedding_dedup.int8_product(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()
