"""Sizes of texts in tokens of a public byte-level BPE vocabulary, read from a file that the caller names."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark.sql import SparkSession

#: The pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(spark: SparkSession) -> str:
    """The session may name another file in veridelta.vocabulary; it must be there on every executor."""
    return spark.conf.get("veridelta.vocabulary", os.path.join(FOLDER, VOCABULARY))


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text, 0 for null. The strings of special tokens are ordinary text; lone surrogates count as U+FFFD."""
    enc = encoder(path).encode_ordinary
    out = []
    for t in texts:
        if not t:
            out.append(0)
            continue
        try:
            out.append(len(enc(t)))
        except UnicodeEncodeError:
            out.append(len(enc(t.encode("utf-8", "replace").decode())))
    return out
