"""Registered queries of the operators, each over its whole table, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.llm import arrow_files, bpe, collocations, embedding_dedup, language_id, line_dedup, matroska, merkle, ngram_join, packing, secrets, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, table: str = "documents", sql: str | None = None):
    def register(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _sql_spans(rule: secrets.Rule, order: int) -> str:
    """Rows doc_id, kind, rank, s, e of one rule: matches and the pieces between them, summed up."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
      SELECT doc_id, '{rule.kind}' AS kind, {order} AS rank, list_sum(p[1:i]) + coalesce(list_sum(n[1:i-1]), 0) AS s, list_sum(p[1:i]) + list_sum(n[1:i]) AS e
      FROM (SELECT doc_id, c, list_transform(m, lambda x: length(x)) AS n, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS p, unnest(range(1, len(m) + 1)) AS i
            FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS c
                  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
      WHERE length(c[i]) >= {rule.least}"""


_ALL = "\n UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(secrets.RULES))
_JOIN = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank)"
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
SECRETS_SQL = f"""
  WITH spans AS ({_ALL}), found AS (
    SELECT doc_id, {_JOIN} AS spans, {_JOIN} FILTER (WHERE kind IN ({_BASE})) AS base,
      {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)}
    FROM spans GROUP BY doc_id)
  SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM documents d LEFT JOIN found USING (doc_id)"""


@query("op1_secret_scans", sql=SECRETS_SQL)
def op1(docs: DataFrame) -> DataFrame:
    found = secrets.find_secrets(docs)
    base = F.filter("secrets", lambda s: s["rank"] < len(secrets.BASE))

    def count(rank: int, kind: str):
        return F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(i, r.kind) for i, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


@query("op2_packing")
def op2(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


NGRAM_SQL = """
  WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  grams AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
  links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
    JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
  FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


@query("op3_ngram_jaccard_join", sql=NGRAM_SQL)
def op3(docs: DataFrame) -> DataFrame:
    return ngram_join.jaccard_components(docs, width=3, threshold=(90, 100), stable=True)


@query("op4_byte_bpe")
def op4(docs: DataFrame) -> DataFrame:
    coded = bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


LINES_SQL = f"""
  WITH lines AS (
    SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
  bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM lines),
  bad AS (SELECT t FROM bare WHERE t <> '' AND source IS NOT NULL GROUP BY t HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
  kept AS (
    SELECT doc_id, count(*) AS n_lines, count(bad.t) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.t IS NULL), '') AS text
    FROM bare LEFT JOIN bad ON bare.t = bad.t GROUP BY doc_id)
  SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text FROM documents d LEFT JOIN kept USING (doc_id)"""


@query("op5_line_dedup", sql=LINES_SQL)
def op5(docs: DataFrame) -> DataFrame:
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


@query("op6_language_id")
def op6(docs: DataFrame) -> DataFrame:
    return language_id.identify(docs).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query("op7_media_columns")
def op7(docs: DataFrame) -> DataFrame:
    return matroska.media_features(matroska.to_media(docs))


VECTORS_SQL = """
  WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
  reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
  SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
  FROM embeddings e JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)"""


@query("op8_embedding_dedup", "embeddings", sql=VECTORS_SQL)
def op8(vectors: DataFrame) -> DataFrame:
    return embedding_dedup.near_vectors(vectors)


@query("op9_arrow_token_files")
def op9(docs: DataFrame) -> DataFrame:
    return arrow_files.round_trip(docs, TOKENIZER)


@query("op10_sharding")
def op10(docs: DataFrame) -> DataFrame:
    return sharding.assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


QUERIES["op11_toxicity"] = op11

PHRASES_SQL = f"""
  WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
  grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM pieces, range(1, {collocations.ORDER + 1}) sizes(size) WHERE len(w) >= size),
  f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY lang, size, phrase HAVING count(*) >= {collocations.LEAST}),
  candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
  cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
  scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (({collocations.SCALE}::HUGEINT * c.a) // (x.a::HUGEINT + y.a))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')),
  best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
  longs AS (SELECT *, unnest(range(2, size)) AS part FROM candidates WHERE size > 2),
  inside AS (SELECT lang, a, unnest(list_transform(range(1, size - part + 2), lambda i: array_to_string(w[i:i + part - 1], ' '))) AS phrase FROM longs),
  around AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY lang, phrase),
  kept AS (SELECT b.* FROM best b LEFT JOIN around USING (lang, phrase) WHERE nth = 1 AND (longer IS NULL OR 100::HUGEINT * longer < {collocations.COVERED}::HUGEINT * a)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
  SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}"""


@query("op12_collocations", sql=PHRASES_SQL)
def op12(docs: DataFrame) -> DataFrame:
    return collocations.phrases(docs, stable=True)


_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f"CAST({c} AS VARCHAR)") for c in merkle.FIELDS[:-1]) + " || " + _FIELD + ")"
#: crc32 of a short text, bit by bit: a byte is taken in, then eight steps (-1) follow.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda ch: list_concat([ascii(ch)::BIGINT], list_resize([]::BIGINT[], 8, -1::BIGINT))))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END), 4294967295::BIGINT)"""
MERKLE_SQL = f"""
  WITH RECURSIVE digests AS (
    SELECT *, {_LEAF.format("text")} AS leaf, CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS tampered FROM documents),
  leaves AS (
    SELECT doc_id, leaf, coalesce(tampered, leaf) AS found, row_number() OVER () AS k, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src,
      row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM digests),
  up AS (
    SELECT src, 0 AS lvl, i, leaf AS d, count(*) OVER (PARTITION BY src) AS n FROM leaves
    UNION ALL SELECT src, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY src, lvl, i // 3),
  subroots AS (SELECT src, d FROM up WHERE n = 1),
  top AS (
    SELECT 0 AS lvl, src AS i, d, count(*) OVER () AS n FROM subroots
    UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, i // 3),
  steps AS (
    SELECT k, lvl AS step, leaves.i // (3 ** lvl)::BIGINT AS p, up.i, d FROM leaves JOIN up ON leaves.src = up.src AND n > 1 AND up.i // 3 = (leaves.i // (3 ** lvl)::BIGINT) // 3
    UNION ALL
    SELECT k, 100 + lvl, src // (3 ** lvl)::BIGINT, top.i, d FROM leaves JOIN top ON n > 1 AND top.i // 3 = (src // (3 ** lvl)::BIGINT) // 3),
  proofs AS (SELECT k, sha256(coalesce(string_agg(d, '' ORDER BY step, i) FILTER (WHERE i <> p), '')) AS proof_sha256 FROM steps GROUP BY k),
  runs AS (
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY step) AS nth, coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE i < p), '') AS before, coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE i > p), '') AS after
    FROM steps GROUP BY k, step),
  folds AS (
    SELECT k, 0::BIGINT AS nth, found AS d FROM leaves
    UNION ALL SELECT f.k, r.nth, sha256(before || d || after) FROM folds f JOIN runs r ON r.k = f.k AND r.nth = f.nth + 1),
  folded AS (SELECT k, arg_max(d, nth) AS folded_root FROM folds GROUP BY k)
  SELECT doc_id, leaf, s.d AS subroot, t.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.d AS verified
  FROM leaves l JOIN subroots s USING (src) JOIN (SELECT d FROM top WHERE n = 1) t ON true JOIN folded USING (k) LEFT JOIN proofs USING (k)"""


@query("op13_merkle_manifest", sql=MERKLE_SQL)
def op13(docs: DataFrame) -> DataFrame:
    found = merkle.manifest(docs, checked=merkle.without_line_ends())
    digests = [F.lower(F.hex(c)).alias(name) for c, name in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    proof = F.sha2(F.encode(F.lower(F.hex("proof")), "UTF-8"), 256)
    return found.select("doc_id", *digests, proof.alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
