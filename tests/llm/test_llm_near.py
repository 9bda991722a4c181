"""The n-gram join and the vector join against all pairs."""

import random
from itertools import combinations

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracle
from rosterspark.llm import common, embedding_dedup, ngram_join, queries


def shingle_set(text, width):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + width]) for i in range(max(1, len(parts) - width + 1))} if parts else set()


def roots(n, links):
    root = list(range(n))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [ra if r == rb else r for r in root]
    return root


def brute(rows, width, num, den):
    sets = [shingle_set(t, width) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return sorted(out, key=str)


def chained(seed):
    """Groups in which each text links with the next but not with those further on, near the threshold on both sides."""
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([3, 8, 25, 60, 90]))]
        for _ in range(12):
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 24))):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 10**6)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width, num, den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_components_are_those_of_all_pairs(spark, width, num, den):
    shared = "this passage stands in very many documents and is long enough to matter for all of them " * 2
    extra = chained(width) + [shared + llm_cases.words(random.Random(i), 40) for i in range(25)]
    base = llm_cases.rows()
    data = base + [(1000 + i, t, *base[0][2:]) for i, t in enumerate(extra)]
    got = ngram_join.jaccard_components(llm_cases.frame(spark, data), width=width, threshold=(num, den))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute([(r[0], r[1]) for r in data], width, num, den)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({w[2] for w in want}) < len(want)


def test_small_chunks_and_tiles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 300)
    monkeypatch.setattr(ngram_join.Chunks.__init__, "__defaults__", (300,))
    monkeypatch.setattr(ngram_join, "TILE", 2000)
    monkeypatch.setattr(ngram_join, "MOST_BITS", 64)
    base = llm_cases.rows()
    data = [(i, t, *base[0][2:]) for i, t in enumerate(chained(5) + chained(6))]
    got = ngram_join.jaccard_components(llm_cases.frame(spark, data), width=3, threshold=(90, 100))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(r[0], r[1]) for r in data], 3, 90, 100)


def test_nothing_to_join(spark):
    assert ngram_join.jaccard_components(llm_cases.empty(spark)).count() == 0
    blank = llm_cases.frame(spark, [r for r in llm_cases.rows() if not (r[1] or "").strip()])
    assert [r["n_shingles"] for r in ngram_join.jaccard_components(blank).collect()] == [0] * blank.count()


def test_one_of_each_component_stays(spark):
    docs = llm_cases.frame(spark).where("doc_id is not null and doc_id <> 3")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [(r[0], r[1]) for r in llm_cases.rows() if r[0] is not None and r[0] != 3]
    want = brute(rows, 5, 80, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in want if d == c)


def test_one_row_of_each_component_stays(spark):
    """Rows, not ids: null and repeated ids, copies beside other texts of one id, repeated rows."""
    base = llm_cases.rows()[0]
    cases = [(1, "one two three four five six"), (5, "one two three four five six"), (5, "quite another text stands here")]
    cases += [(7, "seven seven eight nine ten")] * 3 + [(None, "seven seven eight nine ten"), (None, "null alone in its group of two"), (None, "null alone in its group of two"), (5, None), (5, " ")]
    data = llm_cases.rows() + [(None if d is None else 10_000 + d, t, *base[2:]) for d, t in cases]
    docs = llm_cases.frame(spark, data)
    got = sorted(((r[0], r[1]) for r in ngram_join.keep_one(docs).collect()), key=str)
    sets = [shingle_set(r[1], 5) for r in data]
    root = roots(len(data), [(i, j) for i, j in combinations(range(len(data)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    groups = {}
    for i in range(len(data)):
        groups.setdefault(root[i] if sets[i] else -1 - i, []).append(data[i][:2])
    least = lambda ids: min(ids, key=lambda d: (d is None, d or 0))
    want = [(least([d for d, _ in g]), {t for d, t in g if d == least([d for d, _ in g])}) for g in groups.values()]
    assert sorted((d for d, _ in got), key=str) == sorted((d for d, _ in want), key=str)
    assert all(any(d == e and t in texts for e, texts in want) for d, t in got)
    added = [(d - 10_000, t) for d, t in got if d is not None and d >= 10_000]
    assert sorted(added, key=str) == sorted([(1, cases[0][1]), (5, cases[2][1]), (7, cases[3][1]), (5, None), (5, " ")], key=str)
    assert [d for d, t in got if t == cases[-3][1]] == [None]


def test_no_shingle_is_gathered_in_one_task(spark):
    """Stars without a window; a common shingle, one held once, one repeated by its only node."""
    pairs = [(1, n) for n in range(-40, 40)] + [(2, 7), (3, 9), (3, 9), (4, 5), (4, -3), (4, 5)]
    out = ngram_join.stars(spark.createDataFrame(pairs, "shingle long, node long"), common.Scratch(spark))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == sorted({(n, -40) for n in range(-39, 40)} | {(5, -3)})


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(0, 1 << 60, int(rng.integers(0, 6))).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        held = lambda s: (s % np.uint64(5)).astype(np.uint8)
        if len(b) and 100 * same >= 80 * (len(a) + len(b) - same):
            assert np.intersect1d(ngram_join.prefix(a, held(a), 80, 100), ngram_join.prefix(b, held(b), 80, 100)).size


def test_ngram_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    diff = oracle.compare(spark, oracle.connect(folder), queries.QUERIES["op3_ngram_jaccard_join"], queries.ORACLES["op3_ngram_jaccard_join"], folder)
    assert diff is None, diff


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark)).collect()}
    names = sorted({x for a, b in edges if a != b for x in (a, b)})
    place = {x: i for i, x in enumerate(names)}
    root = roots(len(names), [(place[a], place[b]) for a, b in edges if a != b])
    low = {}
    for x in names:
        low.setdefault(root[place[x]], x)
    assert got == {x: low[root[place[x]]] for x in names}


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in ((40, 0.02), (25, 0.05), (3, 0.01), (60, 0.04)):
        centre = rng.standard_normal(16)
        out += [(centre * rng.uniform(0.1, 50) + noise * np.linalg.norm(centre) * rng.standard_normal(16) / 4).tolist() for _ in range(size)]
    out += [rng.standard_normal(16).tolist() for _ in range(100)] + [out[0]] * 30 + [[x * 2 for x in out[0]], [1e300] * 16, [1e-300] * 16, [1.0] * 8, [2.0] * 8]
    return out + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [0.0] * 15]


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("node", T.StringType()), T.StructField("bucket", T.StringType()), T.StructField("copies", T.StringType())])


def all_pairs(data, least):
    good = [embedding_dedup.usable(v) for v in data]
    unit = [embedding_dedup.normalised(np.array([v], float))[0] if g else None for v, g in zip(data, good, strict=True)]
    return [(i, j) for i, j in combinations(range(len(data)), 2) if good[i] and good[j] and len(data[i]) == len(data[j]) and unit[i] @ unit[j] >= least]


@pytest.mark.parametrize("bucket, tile", [(512, 4096), (8, 16)])
def test_vector_links_are_those_of_all_pairs(spark, monkeypatch, bucket, tile):
    monkeypatch.setattr(embedding_dedup, "BUCKET", bucket)
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    data = vectors()
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in enumerate(data)], SCHEMA).repartition(3)
    links = all_pairs(data, 0.9)
    out = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    root = roots(len(data), links)
    low = {}
    for i in range(len(data)):
        low.setdefault(root[i], i)
    assert len(out) == len(data) and len(links) > 1000
    for i in range(len(data)):
        assert out[i]["n_links"] == sum(i in pair for pair in links) and out[i]["component_id"] == low[root[i]], i
        assert out[i]["kept"] == (i == low[root[i]])


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.90 to 0.93 only, where tables meet least often."""
    rng = np.random.default_rng(9)
    data = []
    for _ in range(300):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        c = rng.uniform(0.9005, 0.93)
        data += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b).tolist()]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in enumerate(data)], SCHEMA)
    found = embedding_dedup.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert found / (2 * len(all_pairs(data, 0.9))) >= 0.9


def test_repeated_null_ids_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (None, None), (2, [-1.0, 1.0])]
    out = embedding_dedup.near_vectors(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)).collect()
    assert sorted([tuple(r) for r in out], key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (2, 0, 2, True)], key=str)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("tile", [ngram_join.TILE, 3000])
def test_links_of_each_document_are_counted(spark, monkeypatch, tile):
    """Copies, near copies and chains: as many links as all pairs give, in shared tiles and in tiles of blocks."""
    monkeypatch.setattr(ngram_join, "TILE", tile)
    shape = llm_cases.rows()[0]
    data = [(1000 + i, t, *shape[2:]) for i, t in enumerate(chained(7) + chained(7)[:20])] + [r for r in llm_cases.rows() if r[0] is not None]
    sets = [shingle_set(r[1], 3) for r in data]
    want = [(r[0], sum(1 for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 90 * len(a | b))) for i, (r, a) in enumerate(zip(data, sets, strict=True))]
    out = ngram_join.jaccard_components(llm_cases.frame(spark, data), width=3, threshold=(90, 100), links=True)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted((r["doc_id"], r["n_links"]) for r in out.collect()) == sorted(want)
    assert max(n for _, n in want) > 10
