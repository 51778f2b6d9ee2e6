"""Sizes of texts in tokens of a public byte-level BPE vocabulary, whose path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is encoded in stretches of about this many characters, cut before a letter that follows a line feed, where the pattern always splits.
STRETCH = 1 << 17


@cache
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, vocabulary: str = VOCABULARY) -> int:
    e, n, at = encoder(vocabulary), 0, 0
    while len(text) - at > STRETCH:
        k = at + STRETCH
        while (k := text.find("\n", k, len(text) - 1) + 1) and not text[k].isalpha():
            pass
        if not k:
            break
        n += len(e.encode_ordinary(text[at:k]))
        at = k
    return n + len(e.encode_ordinary(text[at:]))


def with_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """id, the columns of keep, tokens BIGINT; rows with a null id or text are left out."""
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([count(t, vocabulary) for t in b.columns[-1].to_pylist()], pa.int64())], [*names, "tokens"])

    rows = docs.select(*names, F.col(text_col).alias("__text")).filter(F.col(id_col).isNotNull() & F.col("__text").isNotNull())
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", tokens bigint")
