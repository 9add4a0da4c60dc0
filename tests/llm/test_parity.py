"""The parity join against the Jaccard similarity of every pair."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from weekloom.llm import parity

SCHEMA = "doc_id long, text string, _id long, _text string, node long, n int, a string, root int"


def _set(text, size=4):
    words = brute.WORD.findall(brute.lower_ascii(text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def _near(x, y):
    both = len(x & y)
    return both > 0 and 100 * both >= 85 * (len(x) + len(y) - both)


def _plain(rows):
    """(id, size, component), nulls first; the smallest id names a component."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [_set(t) for _, t in rows]
    roots = brute.components(sets, _near)
    return sorted((str(i), len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, roots))


def _rows(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in parity.jaccard_groups(df).collect())


def _chain(rng, n, edits):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    yield " ".join(words)
    for _ in range(edits):
        for _ in range(max(1, n // 60)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        yield " ".join(words + ["end"] * rng.randint(0, 1))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    texts = [t for k in range(70) for t in _chain(rng, rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 45, 90, 300, 900]), rng.randint(0, 6))]
    texts += [t.upper().replace(" ", "\n ") for t in texts[:9]] + [None, "", " \t", "aaaa " * 3000, "aaaa " * 40, "one", "ONE", "one two"]
    texts += [texts[3]] * 30
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, "text of a row without an id"), (4, "again four words here")]
    return spark.createDataFrame([(*r, 1, "clash", 2, 3, "clash", 4) for r in rows], SCHEMA).repartition(4)


def test_groups(odd):
    want = _plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert _rows(odd) == want
    assert len({r[2] for r in want}) < len(want) - 60


def test_small_buckets_batches_and_parts(odd, monkeypatch):
    for name, value in (("BUCKET_ENTRIES", 300), ("AT_ONCE", 500), ("HELD_ENTRIES", 900), ("SEEN_SETS", 9), ("SET_BYTES", 3000)):
        monkeypatch.setattr(parity, name, value)
    assert _rows(odd) == _plain([(r["doc_id"], r["text"]) for r in odd.collect()])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert _rows(docs) == _plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_empty_table(odd):
    assert parity.jaccard_groups(odd.limit(0)).count() == 0


def test_every_pair_at_the_threshold_shares_an_entry():
    """Pairs that differ in as many elements as a link allows are always candidates."""
    rng = np.random.default_rng(5)
    bands = parity.Bands(85)
    for _ in range(400):
        a = int(rng.integers(7, 700))
        b = int(rng.integers(-(-85 * a // 100), a + 1))
        shared = min(b, -(-85 * (a + b) // 185))
        pool = np.unique(rng.integers(0, 1 << 63, a + b + 50, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        sets = [np.sort(pool[:a]), np.sort(np.concatenate([pool[:shared], pool[a : a + b - shared]]))]
        assert 100 * shared >= 85 * (a + b - shared)
        entries = parity._entries(bands, sets, np.array([1, 2], np.uint64))
        assert len(parity._joined(*entries)[0]) == 1


def test_chains_fit_as_counted_word_by_word():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    flips = [sum(1 << b for b in {int(b) for b in rng.integers(0, 64, int(n))}) for n in rng.integers(0, 9, 4000)]
    b = a ^ np.array(flips, np.uint64)
    want = []
    for x in (a ^ b).tolist():
        sums = np.cumsum([(x >> 8 * j & 255).bit_count() for j in range(8)])
        want.append(all(s <= j + 1 for j, s in enumerate(sums)))
    assert parity.chain_fits(a, b).tolist() == want and 100 < sum(want) < 3900


def test_large_groups_join_what_fits():
    """One key for all entries: the pairs that fit give the same components as the joined stars."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 6).astype(np.uint64)
    chain = np.array([x ^ np.uint64(1 << int(k)) for x in base for k in rng.integers(0, 64, 12)], np.uint64)
    name = np.arange(len(chain)).astype(np.uint64)
    u, v = parity._joined(np.zeros(len(chain), np.uint64), chain, name)
    got = brute.components(name.tolist(), lambda x, y: bool(np.any((u == x) & (v == y) | (u == y) & (v == x))))
    want = brute.components(chain.tolist(), lambda x, y: bool(parity.chain_fits(np.array([x], np.uint64), np.array([y], np.uint64))[0]))
    assert got == want and len(set(want)) >= 6


def test_sketch_bits_bound_the_difference():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    y = np.unique(np.concatenate([x[:350], rng.integers(0, 1 << 62, 40).astype(np.uint64)]))
    words = [parity.sketches(np.sort(s), np.array([len(s)]), np.array([60])) for s in (x, y)]
    differ = len(np.setxor1d(x, y))
    assert 0 < np.bitwise_count(words[0] ^ words[1]).sum() <= differ
