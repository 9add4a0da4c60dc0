"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot i of a single table is a mask whose bit l says
that filter l has bit i. A mask has as many words of 64 bits as the languages need. Looking an n-gram up is the AND of the masks in its slots, which names all
languages that contain it at once. A text's n-grams are counted per language by these bits, and each
count is corrected for the filter's false positives, c' = (c - n p) / (1 - p) with p = fill^hashes.
The language with the largest corrected count is predicted; the score is the share of the text's
n-grams that are in its filter, weighted by its lead over the next language.

Training reads a sample of at most ``sample_docs`` documents per language in expectation, chosen by a
hash of the id (a documented bound: the filters only need the frequent n-grams). An n-gram enters the
filter of a language that has it at least ``min_count`` times in the sample. The model has a fixed
size, ``2^slot_bits`` masks of a bit per language, whatever the corpus, and is what tasks receive.

Cases: every label is learned; a text that is null or has no letter is ``und`` with score 0; so is every text if nothing was
learned; a text none of whose n-grams any filter has gets the commonest language with score 0; a text
shorter than an n-gram is one padded n-gram; ties go to the language first in name order; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import map_batches

UNDETERMINED = "und"
_WORD_BITS = 64
# Below this a filter knows next to nothing of a text; clean texts of a few words reach 0.3 and more.
LEAST_SCORE = 0.1
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
# A text is looked up in windows of this many bytes, which bounds memory; all of it is looked up.
_PIECE = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    masks: np.ndarray  # (words, slots), unsigned
    false_rates: np.ndarray  # per language
    slot_bits: int
    hashes: int
    usual: int = 0  # number of the language most documents have


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of four bytes of the case-folded text, one blank around it."""
    data = np.frombuffer(f" {text.lower()} ".encode().ljust(4), np.uint8).astype(np.uint32)
    return data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24


def slots(codes: np.ndarray, slot_bits: int, hashes: int) -> Iterator[np.ndarray]:
    wide = codes.astype(np.uint64)
    for k in range(hashes):
        yield (wide * _MULTIPLIERS[k]) >> np.uint64(64 - slot_bits)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 2000,
    min_count: int = 3,
    slot_bits: int = 20,
    hashes: int = 2,
) -> LanguageModel:
    """Filters from the labelled rows of ``docs``; rows without a label or a text are not used."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(
        F.col(id_col).cast("string").alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")
    )
    counts = labelled.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["_lang"]: r["n"] for r in counts.collect()}
    languages = tuple(sorted(sizes))
    spread = 1 << 30
    draw = F.pmod(F.xxhash64("_id"), F.lit(spread))
    # One row per label; a chain of conditions would grow with the labels.
    drawn = [(lang, min(spread, spread * sample_docs // n)) for lang, n in sizes.items()]
    shares = docs.sparkSession.createDataFrame(drawn, "_lang string, _share long")
    sample = labelled.join(F.broadcast(shares), "_lang").where(draw < F.col("_share")).select("_lang", "_text")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, langs, counts = [], [], []
        of = np.array([number[v] for v in batch.column("_lang").to_pylist()])
        texts = batch.column("_text").to_pylist()
        for i in np.unique(of):
            c, n = np.unique(np.concatenate([grams(texts[k]) for k in np.flatnonzero(of == i)]), return_counts=True)
            codes.append(c)
            counts.append(n)
            langs.append(np.full(len(c), i))
        return pa.record_batch(
            {
                "code": pa.array(np.concatenate(codes).astype(np.int64)),
                "lang": pa.array(np.concatenate(langs).astype(np.int64)),
                "n": pa.array(np.concatenate(counts).astype(np.int64)),
            }
        )

    counted = map_batches(sample, count, "code long, lang long, n long").groupBy("code", "lang").agg(F.sum("n").alias("n"))
    own = counted.where(F.col("n") >= min_count).groupBy(
        "code", F.floor(F.col("lang") / _WORD_BITS).cast("long").alias("word")
    ).agg(F.bit_or(F.expr(f"shiftleft(1L, int(lang % {_WORD_BITS}))")).alias("mask"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, masks = batch.column("code").to_numpy(), batch.column("mask").to_numpy()
        at = np.concatenate(list(slots(codes, slot_bits, hashes))).astype(np.int64)
        words = np.tile(batch.column("word").to_numpy(), hashes)
        return pa.record_batch({"slot": pa.array(at), "word": pa.array(words), "mask": pa.array(np.tile(masks, hashes))})

    # At most 2^slot_bits rows per word of a mask, whatever was counted.
    placed = map_batches(own, place, "slot long, word long, mask long").groupBy("slot", "word")
    filled = placed.agg(F.bit_or("mask").alias("mask")).toArrow()
    width = np.uint8 if len(languages) <= 8 else np.uint64
    masks = np.zeros((max(1, -(-len(languages) // _WORD_BITS)), 1 << slot_bits), width)
    at = filled.column("word").to_numpy(), filled.column("slot").to_numpy()
    masks[at] = filled.column("mask").to_numpy().view(np.uint64).astype(width)
    fill = np.array([_bit(masks[i // _WORD_BITS], i % _WORD_BITS).mean() for i in range(len(languages))])
    usual = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i), default=0)
    return LanguageModel(languages, masks, fill**hashes, slot_bits, hashes, usual)


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    return (masks >> masks.dtype.type(i)) & masks.dtype.type(1)


def predict_text(model: LanguageModel, text: str | None) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    codes = grams(text)
    counts = np.zeros(len(model.languages))
    for at in range(0, len(codes), _PIECE):
        looked_up = list(slots(codes[at : at + _PIECE], model.slot_bits, model.hashes))
        for word, masks in enumerate(model.masks):
            found = masks[looked_up[0]]
            for slot in looked_up[1:]:
                found = found & masks[slot]
            mine = range(word * _WORD_BITS, min(len(counts), (word + 1) * _WORD_BITS))
            if masks.dtype == np.uint8:
                by_mask = np.bincount(found, minlength=256)
                counts[mine] += [by_mask[_WITH_BIT[i]].sum() for i in mine]
            else:
                counts[mine] += [_bit(found, i % _WORD_BITS).sum() for i in mine]
    corrected = np.maximum(0.0, (counts - len(codes) * model.false_rates) / (1 - model.false_rates))
    best = int(np.argmax(corrected))
    if corrected[best] == 0:
        return model.languages[model.usual], 0.0
    rest = np.delete(corrected, best)
    lead = 1.0 - 0.5 * float(rest.max() / corrected[best]) if len(rest) else 1.0
    return model.languages[best], min(1.0, float(corrected[best]) / len(codes) * lead)


_WITH_BIT = [np.flatnonzero(np.arange(256) >> i & 1) for i in range(8)]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` behind its own columns (named with ``prefix``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def identify(texts):
        return pd.DataFrame([predict_text(shared.value, t) for t in texts], columns=["lang_pred", "score"])

    held = "_identified"
    while held in docs.columns:
        held += "_"
    found = docs.withColumn(held, identify(F.col(text_col)))
    return found.select(
        *docs.columns,
        F.col(f"{held}.lang_pred").alias(f"{prefix}lang_pred"),
        F.col(f"{held}.score").alias(f"{prefix}score"),
    )


def keep_identified(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = LEAST_SCORE
) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with ``least_score`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def identified(texts):
        if not shared.value.languages:
            return texts.map(has_letter)
        found = (predict_text(shared.value, t) for t in texts)
        return pd.Series([lang != UNDETERMINED and score >= least_score for lang, score in found], dtype=bool)

    return docs.where(identified(F.col(text_col)))


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
