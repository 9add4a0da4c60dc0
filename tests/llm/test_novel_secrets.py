"""Secrets of few different characters."""

from __future__ import annotations

import random

import pytest

from weekloom.llm import secret_scan


@pytest.mark.parametrize(
    "letters,length", [("0123456789", 40), ("0123456789abcdef", 20), ("0123456789ABCDEF", 20), ("0123456789ABCDEF", 32)]
)
def test_novelty_alone_decides(letters, length):
    rng = random.Random(length)
    found = 0
    for _ in range(40):
        key = "".join(rng.choices(letters, k=length))
        before, after = "The credential we were given is ", " and it stays in this line of prose"
        novel = secret_scan.novelty(key, before, after) >= secret_scan.LEAST_NOVELTY
        want = [("novel", len(before), len(before) + length)] if novel else []
        assert secret_scan.novel_spans(before + key + after, []) == want
        found += novel
    assert found or letters == "0123456789"
