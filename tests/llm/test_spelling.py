"""Spelling variants against a plain count of words and a plain test of every pair."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import brute
import pytest

from weekloom.llm import spelling

SF = "/root/testdata/sf0.001"


def _edits_once(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _words(rows, rate=199, least=6, often=5):
    counts: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower_ascii(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def _groups(words, factor=5):
    near = {w: [v for v in words if _edits_once(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def _rows(df):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    return {tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcéÿ", k=rng.randint(5, 9))) for _ in range(60)] + ["banana", "a" * 7, "A" * 6, "x" * 3000]
    texts = []
    for i in range(300):
        words = []
        for w in rng.choices(base, weights=[1 + 400 // (k + 1) for k in range(len(base))], k=60):
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "q" + w[at + 1 :]]))
        texts.append((i % 250, rng.choice([" ", "-", "7"]).join(words)))
    texts += [(903, "mountain " * 130 + "mountaim " * 25 + "mountxim " * 5)]
    texts += [(None, "no id here " * 6), (900, None), (901, ""), (902, "Straße ÀÉ×÷Ü Ωmega ő😀" * 9), (1, texts[1][1])]
    return spark.createDataFrame([(*t, "clash", 3, 1, "clash") for t in texts], "doc_id long, text string, word string, n int, s int, unit string")


@pytest.mark.parametrize("rate", [199, 3])
def test_words_and_groups(odd, rate):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = _groups(_words(rows, rate))
    assert _rows(spelling.group_variants(odd, rate=rate)) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_large_units_in_blocks(odd, monkeypatch):
    """Blocks of a few words, so that most units are dealt into pairs of blocks."""
    monkeypatch.setattr(spelling, "BLOCK_CELLS", 300)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert _rows(spelling.group_variants(odd)) == _groups(_words(rows))


def test_counts_handed_on_early(odd, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 7)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {tuple(r) for r in spelling.word_counts(odd).collect()} == set(_words(rows).items())


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _rows(spelling.group_variants(docs)) == _groups(_words(rows))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(none).count() == 0


def test_every_kind_of_edit_is_one_tile():
    words = sorted({w[:i] + c + w[j:] for w in ("abcabc", "aaaaaa") for i in range(7) for j in (i, i + 1) for c in ("", "a", "z")})
    near = Counter()
    for s in range(5, 8):
        for prefix in (True, False):
            for part in {w[: s // 2] if prefix else w[len(w) - (s - s // 2) :] for w in words if len(w) in (s, s + 1)}:
                mine = [w for w in words if len(w) in (s, s + 1) and (w.startswith(part) if prefix else w.endswith(part))]
                for w, n, _, _ in spelling._unit_rows(s, prefix, [0] * len(mine), mine, [1] * len(mine)):
                    near[w] += n
    assert near == Counter({w: sum(_edits_once(w, v) for v in words) for w in words})
