"""The manifest against a plain construction of the trees, and against its SQL."""

import hashlib
import zlib

import llm_cases
import pytest

import oracle
from pyspark.sql import functions as F
from rosterspark.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute(rows):
    """Rows doc_id, leaf, subroot, root, proof_sha256, folded root of (doc_id, text, lang, source, n_chars)."""
    def of(d, t, lang, source, n):
        return h("".join(map(field, (d, source, lang, n, t))))

    def climb(level, paths):
        """The last digest; a list of (before, after) for each item."""
        where = list(range(len(level)))
        while len(level) > 1:
            runs = [level[i : i + 3] for i in range(0, len(level), 3)]
            for item, at in enumerate(where):
                run = runs[at // 3]
                paths[item].append((run[: at % 3], run[at % 3 + 1 :]))
            level, where = [h("".join(r)) for r in runs], [at // 3 for at in where]
        return level[0]

    trees = {}
    for d, t, lang, source, n in rows:
        trees.setdefault(source, []).append((d is not None, d or 0, of(d, t, lang, source, n), t, lang, n, d))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subroots, paths = {}, {}
    for source in order:
        trees[source].sort(key=lambda x: x[:3])
        paths[source] = [[] for _ in trees[source]]
        subroots[source] = climb([x[2] for x in trees[source]], paths[source])
    above = [[] for _ in order]
    root = climb([subroots[s] for s in order], above) if order else None
    out = []
    for i, source in enumerate(order):
        for (_, _, digest, t, lang, n, d), path in zip(trees[source], paths[source], strict=True):
            found = digest
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                found = of(d, None if t is None else t.replace("\n", ""), lang, source, n)
            siblings = ""
            for before, after in path + above[i]:
                siblings += "".join(before + after)
                found = h("".join(before) + found + "".join(after))
            out.append((d, digest, subroots[source], root, h(siblings), found, found == root))
    return sorted(out, key=str)


def digest_rows(docs, levels):
    found = merkle.manifest(docs, checked=merkle.without_line_ends(), block_levels=levels)
    text = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")]
    rows = found.select("doc_id", *text, F.sha2(F.lower(F.hex("proof")).cast("binary"), 256), F.lower(F.hex("folded")), F.col("folded") == F.col("root")).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_the_plain_trees(spark, levels):
    data = llm_cases.rows()
    assert digest_rows(llm_cases.frame(spark, data), levels) == brute([r[:5] for r in data])


def test_one_hot_source_over_several_levels_of_blocks(spark):
    shape = llm_cases.rows()[0]
    data = [(i, f"text {i}\n", "en", "hot" if i % 3 else f"s{i % 31}", 7, *shape[5:]) for i in range(400)] + [(7, "same", None, None, None, *shape[5:])] * 40
    assert digest_rows(llm_cases.frame(spark, data), 1) == brute([r[:5] for r in data])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_few_documents(spark, n):
    data = llm_cases.rows()[:n]
    docs = llm_cases.frame(spark, data) if n else llm_cases.empty(spark)
    assert digest_rows(docs, 8) == brute([r[:5] for r in data])


def test_sweeps_hold_few_messages_and_agree():
    for n in (1, 2, 3, 4, 9, 10, 28, 82):
        foot = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        top, height, inner = merkle.sweep_up(foot)
        assert 3 ** max(height - 1, 0) < n <= 3**height or n == 1
        assert [x[0] for x in inner] == sorted({x[0] for x in inner})
        for digest, (proof, path) in zip(foot, merkle.sweep_down(foot, b"", b""), strict=True):
            assert merkle.fold(digest, proof, path) == top and len(path) == height


def test_tampering_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = merkle.manifest(docs, checked=merkle.without_line_ends()).join(docs, "doc_id")
    rows = found.select("doc_id", "text", (F.col("folded") == F.col("root")).alias("ok")).collect()
    assert len(rows) == docs.count()
    assert all(r["ok"] == ("\n" not in r["text"] or zlib.crc32(str(r["doc_id"]).encode()) % 2 == 1) for r in rows)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op13_merkle_manifest"
    diff = oracle.compare(spark, oracle.connect(folder), queries.QUERIES[name], queries.ORACLES[name], folder)
    assert diff is None, diff
