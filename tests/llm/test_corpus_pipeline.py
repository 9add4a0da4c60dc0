"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

from __future__ import annotations

import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weekloom.llm import decontam, langid, secret_scan

SF = "/root/testdata/sf0.001"


def _plain_redacted(text: str) -> str:
    spans = [s.split(":") for s in filter(None, brute.base_spans(text).split(","))]
    out, at = "", 0
    for _, start, end in sorted(spans, key=lambda s: int(s[1])):
        if int(start) >= at:
            out += text[at : int(start)] + "[REDACTED]"
        at = max(at, int(end))
    return out + text[at:]


def _leaks(text: str, items: list[str]) -> bool:
    words = decontam.words_of(text)
    own = decontam.shingles(words)
    for item in items:
        asked, answer = decontam.question_and_answer(item)
        whole, first = decontam.shingles(decontam.words_of(item)), decontam.shingles(asked)
        if len(whole & own) >= 0.8 * len(whole) and len(first & own) >= 0.5 * len(first):
            if sum(w in words for w in set(answer)) >= 0.5 * len(set(answer)):
                return True
    return False


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after every stage, as the pipeline itself passes them on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900001, None, "en", "s", 0), (900002, "12 -- 34", "en", "s", 8), (900003, "", None, "s", 0)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("_text", F.lit("clash")).withColumn("fp", F.lit(1))
    after = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        after.append(stage(spark, after[-1], SF).cache())
    return after


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "packing",
    ]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_language_stage(stages):
    rows = {r["doc_id"]: r["text"] for r in stages[0].collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    assert kept == {i for i, t in rows.items() if langid.has_letter(t)}


def test_dedup_stage(stages):
    rows = sorted((r["doc_id"], r["text"]) for r in stages[1].collect())
    prints = [brute.fingerprint(t) for _, t in rows]
    roots = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = {rows[i][0] for i in range(len(rows)) if roots[i] == i}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(want)


def test_decontamination_stage(stages, spark):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"] for r in stages[2].collect() if not _leaks(r["text"], items)}
    assert {r["doc_id"] for r in stages[3].collect()} == want and len(want) < stages[2].count()


def test_secret_stage(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        if not secret_scan.novel_spans(text, secret_scan.base_spans(text)):
            assert after[i][0] == _plain_redacted(text)
        assert after[i][1] == len(after[i][0]) and not re.search("[0-9a-f]{24,}", after[i][0])


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces: dict = {}
    for p in stages[5].collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], np.uint32)
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_run_is_the_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    columns = ("doc_id", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    want = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert set(columns) <= set(docs.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
