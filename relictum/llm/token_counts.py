"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, token count), one row for each pair, with one writer at a
time. Texts are looked up by the digest of their normalised content; only distinct texts that the cache misses are
encoded, and their counts are appended.

Defined cases: a null text counts as the empty text; an empty text has no tokens; repeated rows each get the count of
their text; very long texts are encoded whole; an empty table gives an empty table; columns of the input with the names of
the added columns are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.workspace import own_folder

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    """Anything that a tokenizer can tell apart must stay apart, so only null and empty fall together."""
    return F.coalesce(text.cast("string"), F.lit(""))


def load_counter(kind: str, vocabulary: bytes, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, without begin, end or added special tokens."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if kind == "json":
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(vocabulary.decode())
        own.no_padding()
        own.no_truncation()
        return lambda texts: [len(x) for x in own.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(ranked.encode_ordinary(x)) for x in texts]


def encoder(kind: str, vocabulary: bytes, version: str, pattern: str | None, piece_chars: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or load_counter(kind, vocabulary, pattern)
            counts, part, size = [], [], 0
            for text in batch.column("content").to_pylist():
                part.append(text)
                size += len(text)
                if size >= piece_chars:
                    counts += count(part)
                    part, size = [], 0
            counts += count(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column("digest").cast(pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """`docs` with n_bytes (UTF-8) and n_tokens. Without `cache_path` the cache lives in the shared folder for this call."""
    import uuid

    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as file:  # the vocabulary is part of the driver's installation; tasks get its bytes
        vocabulary = file.read()
    kind = tokenizer_path.rpartition(".")[2]
    version = hashlib.sha256(vocabulary + (pattern or "").encode()).hexdigest()
    cache_path = cache_path or f"{own_folder(spark)}/{uuid.uuid4().hex}/token-cache"
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens")

    content = normalised(F.col(text_col))
    keyed = docs.drop("n_bytes", "n_tokens").withColumns({"n_bytes": F.octet_length(content).cast("long"), "__digest": F.unhex(F.sha2(content.cast("binary"), 256))})
    distinct = docs.select(F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    misses = distinct.join(known.select("digest"), "digest", "left_anti")
    misses.mapInArrow(encoder(kind, vocabulary, version, pattern), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    counts = counts.groupBy(F.col("digest").alias("__digest")).agg(F.min("n_tokens").alias("n_tokens"))  # two writers may have added a digest
    return keyed.join(counts, "__digest", "left").drop("__digest")
