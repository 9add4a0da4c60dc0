"""Block-max WAND: nothing above the need is lost, and lists are left unread."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from weekloom.llm import decontam


def _index(rng, vocabulary, weights, n_items, share):
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(8, 30))) for _ in range(n_items)]
    items = [decontam.Item(i, t) for i, t in enumerate(texts)]
    df = Counter(w for item in items for w in set(item.words))
    return decontam.ItemIndex(items, df, n_items, sum(len(i.words) for i in items) / n_items, share)


def _asked(index, passages):
    pairs = [(index.terms[w], p) for p, words in enumerate(passages) for w in words if w in index.terms]
    return (np.array(c, np.int64) for c in zip(*pairs))


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("flat", [False, True])
def test_walk_equals_scoring_everything(monkeypatch, share, flat):
    monkeypatch.setattr(decontam, "_PASSAGES_AT_ONCE", 7)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    index = _index(rng, vocabulary, [1] * 500 if flat else [1 / (i + 1) for i in range(500)], 150, share)
    passages = [[w.encode() for w in rng.choices(vocabulary, k=60)] for _ in range(30)]
    passages += [index.items[i].words + passages[i % 30][:10] for i in range(0, 150, 11)] + [index.items[4].words[:3]]
    got = list(zip(*(c.tolist() for c in index.retrieved(*_asked(index, passages)))))
    want = []
    for p, words in enumerate(passages):
        inside = set(words) & index.terms.keys()
        sums = [sum(v for w, v in impacts.items() if w in inside) for impacts in index.impacts]
        want += [(p, i) for i, s in enumerate(sums) if s >= index.left[i] - 1e-9]
    assert got == want and len(want) >= 14


def test_lists_are_skipped():
    """Common words and the rare ones of one item: the long lists jump to where the rare ones stand."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    index = _index(rng, vocabulary, [40] * 40 + [1] * 2960, 2000, 0.8)
    passages = [index.items[i].words for i in range(0, 2000, 50)]
    counts = Counter()
    found = index.retrieved(*_asked(index, passages), counts)
    assert {(p, 50 * p) for p in range(40)} <= set(zip(*(c.tolist() for c in found)))
    print(counts)
    assert counts["skips"] > 0
    assert counts["read"] < 0.8 * counts["postings"]
    assert counts["scored"] < 0.05 * len(passages) * len(index.items)


def test_passages_without_terms():
    index = _index(random.Random(6), ["a", "b", "c", "d"], [1, 1, 1, 1], 20, 0.6)
    assert list(index.leaks([[], [b"zzz"] * 10], 0.8, 0.5)) == []
    if index.terms:
        one = next(iter(index.terms))
        assert len(index.retrieved(*_asked(index, [[one]]))[0]) >= 0
