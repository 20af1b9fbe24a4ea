"""Text lengths in tokens of a public tokenizer, by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: ranks of a byte-level vocabulary of 50,256 entries
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed values: the splitting pattern that belongs to this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: longer texts are counted in parts, cut before a blank that follows a non-blank, where the pattern always cuts
LONG = 1_000_000


def _encoding(ranks: bytes):
    """The tokenizer, built once a worker process (modules sent by value keep no state between tasks)."""
    import base64
    import hashlib
    import sys

    import tiktoken

    kept = sys.__dict__.setdefault("_kept_tokenizers", {})
    name = hashlib.md5(ranks).hexdigest()
    if name not in kept:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        kept[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return kept[name]


def parts(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of about ``long`` characters whose tokens are those of the whole."""
    import re

    start = 0
    while len(text) - start > long:
        m = re.compile(r"(?<=\S) (?=\S)").search(text, start + long)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def count_tokens(text: str | None, encoding) -> int:
    if not text:
        return 0
    return sum(len(encoding.encode_ordinary(p)) for p in parts(text))


def n_tokens(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text (0 for null and empty). The vocabulary file, of fixed size, travels as a broadcast."""
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(ranks.value)
        for s in batches:
            yield pd.Series([count_tokens(t, enc) for t in s], dtype="int32")

    return count(text)
