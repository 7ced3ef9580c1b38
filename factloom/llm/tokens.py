"""Token counts by public tokenizers; their files are read from a folder given as a parameter and never copied."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def byt5_tokens(text: Column) -> Column:
    """The ByT5 tokenizer: one token per UTF-8 byte and one end token; a null text counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def with_token_counts(df: DataFrame, text_col: str, tokenizer_file: str, out_col: str = "n_tokens") -> DataFrame:
    """Counts by a ``tokenizers`` JSON file at ``tokenizer_file``, a path every executor can read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_file)
        for b in batches:
            sizes = [len(e.ids) for e in tok.encode_batch([t or "" for t in b.column(text_col).to_pylist()])]
            yield b.append_column(out_col, pa.array(sizes, pa.int64()))

    return df.drop(out_col).mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(out_col).schema) + f", `{out_col}` bigint")
