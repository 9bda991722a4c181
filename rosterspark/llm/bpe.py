"""Byte-level BPE encoding and decoding by the tiktoken library from a local rank file."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.tokens import WHITE, slices

#: Texts above this many characters are cut before they are encoded.
LONG = 100_000
#: Cuts are made where white space begins, and before the last of several white-space characters that a word follows.
#: Matches of the split pattern end in both places, whatever stands around them.
#: White space is spelled out: Python's own class also holds U+001C to U+001F, which the library's doesn't.
SAFE_CUT = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[{WHITE}])(?=[{WHITE}][^{WHITE}])")
ALL_WHITE = re.compile(rf"[{WHITE}]+")
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def encoder(path: str, pattern: str):
    """(encode, decode) for the ranks in ``path``: encode gives little-endian unsigned 32-bit ids, decode raw bytes."""
    import base64

    import numpy as np
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    split = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # One match, however long: the split pattern tracks back over long white space and runs out of stack there.
    single = tiktoken.Encoding("single", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if len(text) <= LONG:
            return np.asarray(split.encode_to_numpy(text), "<u4").tobytes()
        out, part, size = [], [], 0
        for chunk in SAFE_CUT.split(text):
            if len(chunk) > LONG and ALL_WHITE.fullmatch(chunk):
                out += [split.encode_to_numpy("".join(part)), single.encode_to_numpy(chunk)]
                part, size = [], 0
                continue
            part.append(chunk)
            size += len(chunk)
            if size > LONG:
                out.append(split.encode_to_numpy("".join(part)))
                part, size = [], 0
        out.append(split.encode_to_numpy("".join(part)))
        return np.concatenate(out).astype("<u4").tobytes()

    def decode(ids: bytes) -> bytes:
        return split.decode_bytes(np.frombuffer(ids, "<u4").tolist())

    return encode, decode


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token ids of every text and the bytes they decode to: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    A map over the rows, without a shuffle; the rank file must exist on every executor. Long texts are cut where
    matches of ``pattern`` (the public byte-level pattern) must end, so memory and the library's stack stay bounded.
    Decoding joins raw token bytes: ids that cut a character in two are no error. Null or empty text: no ids, empty
    bytes. Null or repeated ids of documents pass through, a row each. Empty table: no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, decode = encoder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids = [encode(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([decode(i) for i in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA)
