"""Collocations against plain counting, and against their SQL."""

import re
from collections import Counter

import llm_cases
import numpy as np
import pytest

import oracle
from rosterspark.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    gone = set()
    for (lang, p), (a, *_) in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= 80 * f[lang, p[i : i + size]]:
                    gone.add((lang, p[i : i + size]))
    out, ranks = [], Counter()
    for score, a, phrase, lang, l, r in sorted(((v[3], v[0], " ".join(p).encode(), lang, v[1], v[2]) for (lang, p), v in found.items() if (lang, p) not in gone), key=lambda x: (x[3], -x[0], -x[1], x[2])):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], phrase.decode(), a, l, r, n[lang], score))
    return sorted(out)


def texts():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "New", "york", "city", "É", "ñ", "a-b", "x"]
    out = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 60)))) for _ in range(60)]
    out += ["New York city hall. new york City Hall, in\tspain! the rain; in Spain the rain"] * 12 + ["word " * 500, "in spain\nthe rain\x0bin spain", "", None, " \t ", "...", "\x1c a\x1cb"]
    return out


@pytest.mark.parametrize("least, top, chunk", [(3, 2000, 400_000), (5, 7, 50), (2, 40, 1)])
def test_phrases_equal_plain_counting(spark, monkeypatch, least, top, chunk):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "SLICE", 40)
    monkeypatch.setattr(collocations.count_windows, "__defaults__", (chunk,))
    shape = llm_cases.rows()[0]
    data = [(i, t, ["en", "de", None][i % 3], *shape[3:]) for i, t in enumerate(texts())] + llm_cases.rows()
    got = collocations.phrases(llm_cases.frame(spark, data), least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([(r[2], r[1]) for r in data], least, top)


def test_no_text_no_phrases(spark):
    assert collocations.phrases(llm_cases.empty(spark)).count() == 0


def test_parts_of_a_text_lend_their_first_words(monkeypatch):
    for size in (1, 7, 40):
        monkeypatch.setattr(collocations, "SLICE", size)
        for text in texts():
            found = list(collocations.words(text))
            joined = [w for own, _ in found for w in own]
            assert joined == (text or "").encode().translate(bytes(collocations._TABLE)).replace(b"\xff", b" \xff ").split()
            for (_, ahead), (own, _) in zip(found, found[1:], strict=False):
                assert ahead == own[:3] and len(ahead) == 3


def test_a_rare_word_ends_windows_but_counts():
    chunk = collocations.Chunk("en")
    chunk.add([b"a", b"b", b"a", b"b", b"c", b"a"], [])
    chunk.close()
    number = {w: i for i, w in enumerate(chunk.words)}
    frequent = [np.array([w in (b"a", b"b") for w in chunk.words])] + [np.ones(len(c), bool) for c in chunk.codes[1:]]
    found, counts = chunk.windows(frequent)
    assert counts.sum() == 6 and number[b"c"] not in found[0]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op12_collocations"
    diff = oracle.compare(spark, oracle.connect(folder), queries.QUERIES[name], queries.ORACLES[name], folder)
    assert diff is None, diff
