"""The pipeline's stages, each on all that the one before kept, and the other queries' SQL."""

import corpus_pipeline
import llm_cases
import pytest

import __spark_entry__ as entry
import oracle
from rosterspark.llm import language_id, line_dedup, ngram_join, queries, secrets
from test_llm_near import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_documents_keep_their_columns(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, before, after in stages[:-1]:
        assert after.columns == columns and after.schema == before.schema
        ids = {r["doc_id"] for r in before.collect()}
        assert {r["doc_id"] for r in after.collect()} <= ids


def test_documents_in_a_language_stay(stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    gone = [r for r in before.collect() if r["doc_id"] not in kept]
    assert all(sum(c.isalpha() for c in r["text"] or "") < 0.6 * len(r["text"] or "") for r in gone)
    assert len(kept) >= 0.95 * before.count()


def test_lines_go_but_no_document(stages):
    _, before, after = stages[1]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sites = {}
    for r in before.collect():
        for line in r["text"].split("\n"):
            sites.setdefault(line.strip(" \t\r\x0b\x0c"), set()).add(r["source"])
    for r in after.collect():
        want = "\n".join(x for x in texts.pop(r["doc_id"]).split("\n") if not x.strip(" \t\r\x0b\x0c") or len(sites[x.strip(" \t\r\x0b\x0c")]) < line_dedup.MIN_SITES)
        assert r["text"] == want and r["n_chars"] == len(want)
    assert not texts


def test_one_of_each_stays(stages):
    _, before, after = stages[2]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _, c in brute(rows, 5, 80, 100) if d == c)


def test_secrets_go_but_no_document(stages):
    _, before, after = stages[3]
    assert before.count() == after.count()
    assert not [r for r in secrets.find_secrets(after).collect() if r["secrets"]]
    clean = {r["doc_id"]: r["text"] for r in secrets.find_secrets(before).collect() if not r["secrets"]}
    assert clean.items() <= {r["doc_id"]: r["text"] for r in after.collect()}.items()


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, stages[4][2].select("doc_id", "start", "length", "ids_crc32").collect()))
    assert {r["doc_id"] for r in stages[4][2].collect()} == {r["doc_id"] for r in stages[3][2].collect()}


def test_stages_take_rows_of_any_kind(spark):
    for data in (llm_cases.frame(spark), llm_cases.empty(spark)):
        docs = data.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, FOLDER).count()


def test_stage_methods():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "secret_scans", "packing"]
    assert language_id.LEAST_SCORE > 0 and ngram_join.needed(10, 80, 100) == 8


@pytest.mark.parametrize("name", ["op1_secret_scans", "op5_line_dedup", "op8_embedding_dedup"])
def test_query_equals_its_sql(spark, name):
    diff = oracle.compare(spark, oracle.connect(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert diff is None, diff


def test_registered():
    assert queries.QUERIES.keys() <= entry.queries().keys() and queries.ORACLES.keys() <= entry.oracle_sql().keys()
