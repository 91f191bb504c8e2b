"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rank file of a byte-level tokenizer for many languages; a parameter of every operator, never copied.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how such a vocabulary divides text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    """Tokenizer of a rank file; read once in each process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row; null and empty texts have 0 tokens. Whole texts are read."""
    types = dict(documents.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names=[*keys, "n_tokens"])

    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return documents.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text")).mapInArrow(count, f"{ddl}, n_tokens bigint")
