"""The manifest against a tree built level by level, in blocks of several sizes."""

from __future__ import annotations

import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from weekloom.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def _path(nodes, at):
    """Siblings (left, right) of node ``at`` per level, and the root."""
    path = []
    while len(nodes) > 1:
        first = at // 8 * 8
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        nodes = [_h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at //= 8
    return path, nodes[0]


def _plain(rows):
    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
        trees[lang] = mine, [_leaf(r) for r in mine]
    subroots = [_path(trees[k][1], 0)[1] for k in langs]
    out = []
    for number, lang in enumerate(langs):
        above, root = _path(subroots, number)
        for at, row in enumerate(trees[lang][0]):
            path = _path(trees[lang][1], at)[0] + above
            shown = row
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                shown = row.asDict() | {"text": None if row["text"] is None else brute.lower_ascii(row["text"])}
            folded = _leaf(shown)
            for left, right in path:
                folded = _h(left + folded + right)
            proof = _h("".join(a + b for a, b in path))
            out.append((str(row["doc_id"]), _leaf(row), subroots[number], root, proof, folded, folded == root))
    return sorted(out)


def _rows(df, levels):
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(df, tampered={"text": merkle.lower_ascii(F.col("text"))}, tampered_where=where, levels=levels)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in found.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, pos long, _row int, _seq int, total int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    # Trees of 1, 8, 9, 64, 65 and 150 leaves; a key without a name, one that is empty, one above ASCII.
    sizes = {"one": 1, "": 8, None: 9, "é": 64, "z": 65, "en": 150, "solo": 1, "a": 2, "b": 3}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 1009, f"Text {i} ÀÉ", lang, "s", i))
    rows += [(None, None, "en", None, None), (None, "", "en", "", 0), (3, "x" * 40_000, "en", "s", 1)]
    rows += [(5, "Same row", "z", "s", 8)] * 9 + [(5, "other row", "z", "s", 8)]
    df = _table(spark, rows)
    want = _plain(df.collect())
    assert _rows(df, levels) == want
    assert {r[-1] for r in want} == {True, False}


def test_single_rows_and_no_rows(spark):
    one = _table(spark, [(1, "A", "en", "s", 1)])
    assert _rows(one, 4) == _plain(one.collect())
    several = _table(spark, [(k, "a", str(k), "s", 1) for k in range(20)])
    assert _rows(several, 1) == _plain(several.collect())
    assert _rows(one.limit(0), 4) == []


@pytest.mark.parametrize("n", [*range(1, 20), 63, 64, 65, 72, 73, 512, 513])
def test_witnesses_of_a_growing_tree(n):
    leaves = [_h(str(i)) for i in range(n)]
    tree = merkle.WitnessTree()
    for leaf in leaves:
        tree.append(leaf)
    root = tree.finish()
    for i in (0, n // 2, n - 1):
        path, want = _path(leaves, i)
        assert root == want and list(zip(*tree.path(i))) == path
        assert merkle.fold(leaves[i], *tree.path(i)) == root
        assert (merkle.fold(_h("other"), *tree.path(i)) == root) is False
