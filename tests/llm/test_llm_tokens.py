"""Packing, BPE and Arrow files against the plain libraries."""

import zlib
from collections import defaultdict

import llm_cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rosterspark.llm import arrow_files, bpe, packing, queries, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def data(ids):
    return np.array(ids, "<u4").tobytes()


ODD = ["", " ", "a", "  a  b ", "\n\n x\t y <|endoftext|> z", "it's  we'll go 12 3 x\r\n", "don't 'tis ' s", "é́ \U0001f600\U0001f600 b", "\x1c a \x1f b", "a \x1d b\x85c ​ d", "x" * 5000 + " " + "\n" * 300, "foo. Bar\nbaz  \n  q", "﻿ a", "a ̀b", "straße, größe. ñandú\n élan", "A.B,C. d,"]


def test_words_joined_are_the_text_encoded(plain):
    for some in (ODD, [t or "" for t in llm_cases.texts()]):
        assert [tuple(np.frombuffer(i, "<u4")) for i in tokens.FileEncoder(queries.TOKENIZER).ids(some)] == [tuple(plain(t)) for t in some]


def test_every_id_is_in_one_piece_of_a_window(spark, plain):
    docs = llm_cases.frame(spark)
    out = packing.pack(docs, queries.TOKENIZER, capacity=256, block=64, piece=60).collect()
    want = sorted(((d, zlib.crc32(data([*plain(t), 1])), len(plain(t)) + 1) for d, t in ((r[0], r[1]) for r in llm_cases.rows())), key=str)
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256
    single = [d for d in {w[0] for w in want} if sum(w[0] == d for w in want) == 1]
    for d in single:
        ids = [*plain(next(r[1] for r in llm_cases.rows() if r[0] == d)), 1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(data(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in out) == sum(w[2] for w in want)
    assert sum(r["length"] for r in out) / (256 * len(windows)) > 0.9


def test_packing_nothing(spark):
    assert packing.pack(llm_cases.empty(spark), queries.TOKENIZER).count() == 0


def test_differencing_is_near_equal_and_keeps_capacity():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 513, 700).tolist()
    groups = packing.windows(sizes, 2048)
    assert sorted(i for g in groups for i in g) == list(range(700))
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert max(sums) <= 2048 and max(sums) - min(sums) < 64 and len(groups) <= -(-sum(sizes) // 2048) + 1
    assert packing.differenced([8, 7, 6, 5, 4], 2) and sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differenced([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.windows([10, 10, 10], 10) == [[2], [1], [0]] or len(packing.windows([10, 10, 10], 10)) == 3
    assert packing.windows([], 10) == []


def test_more_windows_when_capacity_is_exceeded():
    groups = packing.windows([6, 6, 6, 6], 10)  # 24 fit three windows by total, not by size
    assert len(groups) == 4


def test_bpe_round_trip(spark, plain):
    out = bpe.encode_decode(llm_cases.frame(spark), queries.RANKS, public_tokenizers.PATTERN).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in out), key=str)
    want = sorted(((r[0], len(plain(r[1])), data(plain(r[1])), (r[1] or "").encode()) for r in llm_cases.rows()), key=str)
    assert got == want
    assert bpe.encode_decode(llm_cases.empty(spark), queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_long_texts_is_cut_safely(plain):
    encode, decode = bpe.encoder(queries.RANKS, public_tokenizers.PATTERN)
    for text in (" \n x  yy'll 12\t\t é" * 20_000, "ab" * 150_000, "a" + " " * 250_000 + "b", "\n" * 250_000, "x " * 120_000):
        assert encode(text) == data(plain(text))
        assert decode(encode(text)) == text.encode()
    spaces = "a" + " " * 3_000_000 + "b"  # beyond the library's own stack
    assert decode(encode(spaces)) == spaces.encode()


def want_order(plain, rows):
    start, out = 0, []
    for d, t in rows:
        ids = [*plain(t), 2]
        out.append((d, start, len(ids), zlib.crc32(data(ids))))
        start += len(ids)
    return out


def test_arrow_files_hold_the_stream(spark, plain):
    rows = [(r[0], r[1]) for r in llm_cases.rows() if r[0] is not None and not (r[0] == 3)]
    docs = llm_cases.frame(spark).where("doc_id is not null and doc_id <> 3")
    out = arrow_files.round_trip(docs, queries.TOKENIZER, length=64, batch_rows=3)
    got = sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want_order(plain, sorted(rows, key=lambda r: r[0]))


def test_arrow_files_with_ties_nulls_and_nothing(spark, plain):
    out = arrow_files.round_trip(llm_cases.frame(spark), queries.TOKENIZER, length=32).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in out if r["doc_id"] is not None) == sorted((r[0], zlib.crc32(data([*plain(r[1]), 2]))) for r in llm_cases.rows() if r[0] is not None)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    starts = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert starts[:2] == [None, None] and starts[2:] == sorted(starts[2:])
    assert arrow_files.round_trip(llm_cases.empty(spark), queries.TOKENIZER).count() == 0


def test_sequences_are_read_in_place(spark, plain, tmp_path):
    docs = llm_cases.frame(spark).where("doc_id in (1, 2, 50)")
    files = arrow_files.write_tokens(docs.coalesce(1), queries.TOKENIZER, f"file://{tmp_path}", length=16, batch_rows=2).orderBy("part").collect()
    stream = []
    for f in files:
        for i in range(f["sequences"]):
            ids, mask = arrow_files.read_sequence(f["file"], i // 2, i % 2)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            stream += ids[mask].tolist()
    texts = {r[0]: r[1] for r in llm_cases.rows()}
    assert stream == [i for d in (1, 2, 50) for i in [*plain(texts[d]), 2]]
    assert sum(f["tokens"] for f in files) == len(stream)


def test_queries_over_the_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [tuple(r) for r in queries.QUERIES["op9_arrow_token_files"](spark, folder).orderBy("doc_id").collect()]
    assert got == want_order(plain, sorted(docs.items()))
    four = {r["doc_id"]: r for r in queries.QUERIES["op4_byte_bpe"](spark, folder).collect()}
    assert {d: r["n_tokens"] for d, r in four.items()} == {d: len(plain(t)) for d, t in docs.items()}
    two = queries.QUERIES["op2_packing"](spark, folder)
    totals = {r["doc_id"]: r["s"] for r in two.groupBy("doc_id").agg(F.sum("length").alias("s")).collect()}
    assert totals == {d: len(plain(t)) + 1 for d, t in docs.items()}
    assert two.agg((F.sum("length") / F.count_distinct("sequence_id") / 2048).alias("full")).first()["full"] > 0.97


def odd_texts(count, seed):
    """Random texts in which white space, control characters, marks and letters of many kinds stand side by side."""
    rng = np.random.default_rng(seed)
    pool = [chr(c) for c in [*range(0x20), 0x20, 0x20, 0x20, 0x0A, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF, 0x180E]] + list("abzAZ019.,'!é") + ["'s", "'ll", "ß", "ñ", "日", "\u0301", "\U0001f600"]
    pool += [chr(int(c)) for c in rng.integers(0, 0x3000, 200)]
    return ["".join(rng.choice(pool, int(rng.integers(1, 30)))) for _ in range(count)]


def test_cuts_are_safe_between_any_characters(monkeypatch):
    import base64

    import tiktoken

    monkeypatch.setattr(bpe, "LONG", 3)
    encode, decode = bpe.encoder(queries.RANKS, public_tokenizers.PATTERN)
    with open(queries.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in [*odd_texts(20_000, 1), "\n\n\x1c2" * 300, "abc" + "\n\n\x1c2" * 300, *ODD]:
        ids = encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode_ordinary(text), repr(text)
        assert decode(ids) == text.encode()


def test_words_may_be_joined_between_any_characters(plain):
    encoder = tokens.FileEncoder(queries.TOKENIZER)
    some = [*odd_texts(10_000, 2), *(" ".join(odd_texts(8, s)) for s in range(300))]
    for at in range(0, len(some), 500):
        got = encoder.ids(some[at : at + 500])
        for text, ids in zip(some[at : at + 500], got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


def test_white_space_at_the_ends_of_texts(plain):
    some = [" ", "\n", " a", "a ", "\na", "a\n", " a\nb ", "\n \n", "a b\nc\nd e\n", "a\0b", "\0", "\u3000a", "x" * 300_000 + " \t" + "y " * 100_000]
    got = tokens.FileEncoder(queries.TOKENIZER).ids(some * 2)
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [plain(t) for t in some] * 2
