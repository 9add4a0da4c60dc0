"""More languages than a mask word has bits."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weekloom.llm import langid


def test_seventy_languages(spark):
    rng = random.Random(9)
    rows = []
    for k in range(70):
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6))
        for _ in range(3 + (k < 64)):
            rows.append((len(rows), " ".join("".join(rng.choices(letters, k=4)) for _ in range(150)), f"l{k:02d}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, min_count=1)
    assert len(model.languages) == 70 and model.masks.shape[0] == 2
    got = langid.predict(df, model).collect()
    assert all(any(r["lang"] == name == r["lang_pred"] for r in got) for name in model.languages)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(rows)
    assert langid.keep_identified(df.where(F.col("lang") >= "l64"), model).count() == 18
