"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_package

#: A tokenizer file that every executor can read.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of documents with a text of at least one token; equal rows count once, of rows of one doc_id that differ the longest.

    A null source is an empty one. Rows without doc_id or text don't come out.
    """

    ship_package(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = load(path)
        for b in batches:
            sizes: list[int] = []
            for at in range(0, len(b), 256):
                sizes += [len(e.ids) for e in t.encode_batch_fast(b["text"].iloc[at : at + 256].tolist(), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": sizes})

    d = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    sized = d.mapInPandas(run, "doc_id long, source string, tokens long").where("tokens > 0")
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens")
