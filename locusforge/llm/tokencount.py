"""Token counts through a digest cache.

A row of the cache holds the digest of a content, the digest of the tokenizer's file, and the count. Contents are
normalised only by taking null as empty, as anything more could change counts. Distinct contents that the cache lacks
are encoded once and appended; counts are joined back to all documents.

Edge cases: null and empty texts have no tokens; special strings in texts are handled as the library does by default;
repeated rows and null ids are kept; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_LOADED: dict[str, object] = {}


def counter(path: str):
    """texts -> token counts, by the library that the file is for; loaded once a worker."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _LOADED[path] = lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _LOADED[path]


def version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit). cache: a folder; without one a new one is begun."""
    spark = docs.sparkSession
    shared.prepare(spark)
    cache = cache or shared.scratch(spark, "token-counts")
    name = version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    paths = shared.materialize(docs.select("doc_id", shared.key_text("doc_id").alias("path"), F.unhex(F.sha2(text, 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes")), "contents")
    missing = paths.groupBy("content").agg(F.min("path").alias("path"))
    if shared.exists(spark, cache):
        missing = missing.join(_stored(spark, cache, name), "content", "left_anti")
    missing = shared.materialize(missing, "missing")
    keyed = docs.select(shared.key_text("doc_id").alias("path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    spare = shared.materialize(paths.select("path", "content").join(missing, ["path", "content"], "left_anti").distinct(), "spare")
    todo = shared.without(keyed, spare, ["path", "content"])  # one row at least of each missing content

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for rows, _, _ in shared.steps(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([rows.column("content"), pa.array(np.array(count(rows.column("text").to_pylist()), np.int64))], ["content", "n_tokens"])

    fresh = todo.select("content", "text").mapInArrow(encode, "content binary, n_tokens long").dropDuplicates(["content"])
    fresh.withColumn("tokenizer", F.lit(name)).write.mode("append").parquet(cache)
    counts = _stored(spark, cache, name, "n_tokens").dropDuplicates(["content"])
    joined = shared.join_spread(paths.select("doc_id", "n_bytes", "content"), counts, "content")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, cache: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(cache).where(F.col("tokenizer") == name).select("content", *columns)
