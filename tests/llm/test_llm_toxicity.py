"""The conditional random field against sums over all taggings, and scores against held-out labels."""

import itertools
import zlib

import llm_cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterspark.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def plain(scores, moves, begin):
    """Marginals, expected moves and log sum by listing every tagging of one chain."""
    weights = {}
    for tags in itertools.product((0, 1), repeat=len(scores)):
        weights[tags] = np.exp(begin * tags[0] + sum(s for s, t in zip(scores, tags, strict=True) if t) + sum(moves[a][b] for a, b in itertools.pairwise(tags)))
    total = sum(weights.values())
    marginal = [sum(w for t, w in weights.items() if t[i]) / total for i in range(len(scores))]
    expected = np.zeros((2, 2))
    for tags, w in weights.items():
        for a, b in itertools.pairwise(tags):
            expected[a, b] += w / total
    return np.array(marginal), expected, np.log(total)


def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(5)
    moves = rng.normal(size=(2, 2)) * 2
    chains = [rng.normal(size=n) * 4 for n in (1, 2, 7, 10, 3)]
    starts = np.concatenate([np.arange(len(c)) == 0 for c in chains])
    marginal, expected = toxicity.forward_backward(np.concatenate(chains), starts, moves, -1.5)
    want = [plain(c, moves, -1.5) for c in chains]
    assert np.allclose(marginal, np.concatenate([w[0] for w in want])) and np.allclose(expected, sum(w[1] for w in want))


def test_long_chains_neither_vanish_nor_overflow():
    marginal, _ = toxicity.forward_backward(np.tile([-25.0, 25.0], 20_000), np.arange(40_000) == 0, np.array([[0.5, -3.0], [-3.0, 0.5]]), 0.0)
    assert np.isfinite(marginal).all() and (marginal[1::2] > 0.9).all() and (marginal[::2] < 0.1).all()


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(6)
    theta = rng.normal(size=toxicity.DIMENSIONS) * 0.5
    words = "a b c a d".split()
    starts = np.arange(5) == 0
    places, tags = toxicity.features(words, starts), np.array([0, 1, 1, 0, 1.0])

    def likelihood(t):
        scores, moves = t[places].sum(axis=0) + t[toxicity.BIAS], t[toxicity.MOVES :].reshape(2, 2)
        path = scores @ tags + t[toxicity.BEGIN] * tags[0] + sum(moves[int(a), int(b)] for a, b in itertools.pairwise(tags))
        return path - plain(scores, moves, t[toxicity.BEGIN])[2]

    slope = toxicity.gradient(theta, places, starts, tags)
    for i in [int(places[0, 0]), int(places[2, 3]), int(places[3, 1]), toxicity.BIAS, toxicity.BEGIN, toxicity.MOVES + 1, toxicity.MOVES + 3]:
        step = np.zeros(toxicity.DIMENSIONS)
        step[i] = 1e-5
        assert np.isclose(slope[i], (likelihood(theta + step) - likelihood(theta - step)) / 2e-5, atol=1e-6)


@pytest.fixture(scope="module")
def labelled(spark):
    """Invented texts in which three words make toxic ones, with rows of any kind around them."""
    rng = np.random.default_rng(8)
    shape = llm_cases.rows()[0]
    vocabulary = ["w" + "".join(rng.choice(list("abcdefg"), 4)) for _ in range(300)]
    data, labels = [], []
    for i in range(1000, 1700):
        words = list(rng.choice(vocabulary, int(rng.integers(5, 60))))
        bad = i % 4 == 0
        if bad:
            for w in rng.choice(["Vile", "rotten", "filth"], int(rng.integers(1, 4))):
                words.insert(int(rng.integers(0, len(words))), w)
        data.append((i, " ".join(words), *shape[2:]))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (1001, 1, None), (5, 1, 0), (999_999, 0, 1)]
    return llm_cases.frame(spark, data + llm_cases.rows()), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: (r[1], t) for r, (_, _, t) in zip(data, labels, strict=False)}


def test_words_and_spans_are_found(spark, labelled):
    docs, labels, known = labelled
    model = toxicity.fit(docs, labels)
    assert set(model.words) >= {"vile", "rotten", "filth"} and len(model.words) <= 8
    marking = frozenset(model.words)
    out = toxicity.tag(docs, model)
    rows = out.collect()
    assert out.columns == ["doc_id", "score", "n_tokens", "spans"] and len(rows) == docs.count()
    right = 0
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in known:
            text, toxic = known[r["doc_id"]]
            right += (r["score"] >= 0.5) == bool(toxic)
            assert all(toxicity.marks(text[s["start"] : s["end"]].lower().split()[0], marking) for s in r["spans"])
    assert right >= 0.98 * len(known)


def test_long_texts_are_tagged_in_parts(monkeypatch):
    theta = np.zeros(toxicity.DIMENSIONS)
    theta[toxicity.BIAS] = -6
    theta[toxicity.hashed(["vile"])[0]] = 12
    text = "clean words and vile ones\nthen " * 200
    whole = toxicity.Tagger(theta).tag([text, "", "vile"])
    monkeypatch.setattr(toxicity.parts, "__defaults__", (50,))
    cut = toxicity.Tagger(theta).tag([text, "", "vile"])
    assert "".join(toxicity.parts(text)) == text and len(toxicity.parts(text)) > 50
    assert [(s, e) for s, e, _ in whole[0][3]] == [(s, e) for s, e, _ in cut[0][3]] == [(i + 16, i + 20) for i in range(0, len(text), 31)]
    assert whole[0][2] == cut[0][2] == len(text.split()) and whole[1] == (0.0, 0.0, 0, []) and whole[2][3][0][:2] == (0, 4)


def test_nothing_to_learn_from(spark):
    docs, none = llm_cases.frame(spark), spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, ones).collect()} == {1.0}
    assert toxicity.score_documents(llm_cases.empty(spark), ones).count() == 0


def test_held_out_labels(spark):
    """The registered query over its tables: every row, nothing learned from held-out labels, and most of them met."""
    out = queries.QUERIES["op11_toxicity"](spark, FOLDER)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "spans"]
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for d, r in rows.items())
    labels = [(rows[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    held = [(r, t) for r, t in labels if r["held_out"]]
    toxic, clean = [r["score"] for r, t in held if t], [r["score"] for r, t in held if not t]
    # A tenth or so of the toxic labels stand on texts without any sign.
    assert len(toxic) >= 80
    assert sum(a > b for a in toxic for b in clean) >= 0.93 * len(toxic) * len(clean)
    assert sum(s >= 0.5 for s in toxic) >= 0.85 * len(toxic) and sum(s >= 0.5 for s in clean) <= 0.015 * len(clean)


def test_other_columns_say_nothing(spark, labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    changed = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "score": F.lit("y")})
    assert sorted(map(str, toxicity.tag(docs, model).collect())) == sorted(map(str, toxicity.tag(changed, model).collect()))
