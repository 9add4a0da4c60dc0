"""Token counts through a digest cache.

The cache is a Parquet folder with one row per content and tokenizer version: ``tokenizer_version``,
``content_digest`` (SHA-256 of the normalised text), ``n_bytes``, ``n_tokens``. A run joins the digests
of its documents to the cache, encodes one text per missing digest and appends the counts. A task
that is run again may append a digest twice; readers take one row per digest.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated documents are encoded once and keep
a row each; documents with equal ids are counted apart; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import WordCache, map_batches, path_exists
from weekloom.session import write_table

CACHE_SCHEMA = "tokenizer_version string, content_digest string, n_bytes long, n_tokens long"
# Missing digests sent to all tasks at most: some 20 MB. More of them are joined after a shuffle.
BROADCAST_DIGESTS = 200_000
_MARK = "▁"
_UNITS = re.compile(f"{_MARK}+[^{_MARK}]*")


class PieceCounter:
    """Counts SentencePiece tokens of a text, word by word.

    Where no piece of the model holds the word mark behind another character, no merge can cross the
    start of a word. The count of a text is then the sum over its words, which are remembered. A model
    with other pieces, or one whose normaliser changes texts, is given whole texts.
    """

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        inner = any(_MARK in piece.lstrip(_MARK) for piece in pieces)
        probe = " ﬁ  Å　x "
        plain = self.model.normalize(probe) == _MARK + probe.replace(" ", _MARK)
        self.by_word = plain and not inner
        self.counts = WordCache(lambda unit: len(self.model.encode(unit)))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return len(self.model.encode(text))
        if "  " not in text and _MARK not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.counts.__getitem__, text.split(" ")))
        # The library puts a mark in front of a text, so a unit is given to it without its first mark.
        units = _UNITS.findall(_MARK + text.replace(" ", _MARK))
        return sum(self.counts[u[1:]] if len(u) > 1 else 1 for u in units)


@lru_cache(maxsize=2)
def piece_counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def tokenizer_version(model_file: str) -> str:
    """The digest of the vocabulary file: counts of another vocabulary are never reused."""
    return hashlib.sha256(Path(model_file).read_bytes()).hexdigest()


def content_digest(text: Column) -> Column:
    """Normalised content: null is empty. Nothing else is folded, as it would change counts."""
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    model_file: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 4096,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row of ``docs``; appends misses to the cache."""
    spark = docs.sparkSession
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")
    version = tokenizer_version(model_file)
    name = Path(model_file).name

    def cached() -> DataFrame:
        if not path_exists(spark, cache_path):
            return spark.createDataFrame([], CACHE_SCHEMA)
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)

    def known() -> DataFrame:
        own = cached().where(F.col("tokenizer_version") == version)
        return own.groupBy("content_digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))

    texts = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
        content_digest(F.col(text_col)).alias("content_digest"),
    )

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        local = model_file if Path(model_file).exists() else public_tokenizers.path(name)
        count = piece_counter(local)
        values = batch.column("_text").to_pylist()
        return pa.record_batch(
            {
                "tokenizer_version": pa.array([version] * len(values)),
                "content_digest": batch.column("content_digest"),
                "n_bytes": pa.array([len(v.encode()) for v in values], pa.int64()),
                "n_tokens": pa.array([count(v) for v in values], pa.int64()),
            }
        )

    digests = texts.select("content_digest").distinct()
    missing = write_table(digests.join(known().select("content_digest"), "content_digest", "left_anti"), "missing")
    # Copies of a text become one row per task before anything is shuffled, so the join with the missing
    # digests comes either before that, as a broadcast of a checked size, or after it.
    few = missing.count() <= BROADCAST_DIGESTS
    wanted = texts.select("content_digest", "_text")
    if few:
        wanted = wanted.join(F.broadcast(missing), "content_digest", "left_semi")
    first = wanted.groupBy("content_digest").agg(F.first("_text").alias("_text"))
    misses = first if few else first.join(missing, "content_digest", "left_semi")
    map_batches(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # A stored table, not an aggregate, on the other side: adaptive execution can then split the rows of
    # a content that very many documents share.
    counts = write_table(known(), "token-counts")
    counted = texts.select("_id", "content_digest").join(counts, "content_digest", "left")
    return counted.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit")
    )
