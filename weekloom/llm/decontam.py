"""Benchmark decontamination: a BM25 index of test items that every training passage queries.

Items are the documents of a BM25 collection; the index keeps, per term, blocks of ``BLOCK_ITEMS``
items with the largest impact in the block. Passages are windows of twice the longest item's words, each
starting where half the one before has passed, so a copy of any item lies whole in some passage. All
items whose BM25 score reaches ``least_score`` of what the item's own words score are retrieved by
block-max WAND, all passages of a batch side by side:

- terms that most items share are set aside as long as an item can lose them all and still need the
  rest (their sum per item is known), so their long lists are never opened;
- a passage has a cursor in the list of each other term; ordered by their items, the first cursors whose
  lists' maxima together reach what the easiest item needs end at the pivot, no item before it can do;
- where the maxima of those lists in the pivot's block stay below what the block's easiest item needs, all of
  them skip to the end of the block or to the next cursor's item;
- otherwise cursors before the pivot move to it; where they all stand on it the item is scored exactly.

A retrieved item is a leak if the passage holds ``containment`` of its five-word shingles and at least
``least_overlap`` of its question (shingles) and of its answer (words). The answer is the last sentence,
or the last third of a text of one sentence.

The index is built and broadcast in parts of at most ``PART_WORDS`` words of items, one pass each, so a
benchmark of any size fits; collection statistics are those of all items. Passages are not sent anywhere.

Cases: null and empty texts leak nothing; items of fewer than five words, or null, take no part; items
that repeat each other are all reported; equal document ids and repeated rows are searched as rows and
reported once per id and item; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import map_batches

K1, B = 1.2, 0.75
SHINGLE = 5
BLOCK_ITEMS = 8
PART_WORDS = 2_000_000
LEAST_SCORE = 0.6
CONTAINMENT = 0.8
LEAST_OVERLAP = 0.5
# Words handled at once; bounds a task's memory, not a text's length.
_WORDS_AT_ONCE = 1 << 19
_PASSAGES_AT_ONCE = 4096

# ASCII that is neither letter nor digit separates words.
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_BLANKS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    sentences = [w for w in map(words_of, _SENTENCE.split(text.strip())) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:]


def shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


class Item:
    def __init__(self, item_id, text: str):
        self.id = item_id
        self.words = words_of(text)
        question, answer = question_and_answer(text)
        self.shingles = shingles(self.words)
        self.question = shingles(question) or {b" ".join(question)}
        self.answer = set(answer)


class ItemIndex:
    """Postings, block maxima and thresholds of one part of the items."""

    def __init__(self, items: list[Item], df: dict[bytes, int], n_items: int, mean_words: float, least_score: float):
        self.items = items
        self.impacts: list[dict[bytes, float]] = []
        for item in items:
            norm = K1 * (1 - B + B * len(item.words) / mean_words)
            self.impacts.append(
                {
                    t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                    for t, tf in Counter(item.words).items()
                }
            )
        self.needed = np.array([least_score * sum(i.values()) for i in self.impacts])
        postings: dict[bytes, list[int]] = {}
        for number, impacts in enumerate(self.impacts):
            for t in impacts:
                postings.setdefault(t, []).append(number)
        # Most common first: a term is set aside while no item loses half of what it needs by that.
        lost = np.zeros(len(items))
        aside = set()
        for t in sorted(postings, key=lambda t: (-df[t], t)):
            at = postings[t]
            loss = np.array([self.impacts[i][t] for i in at])
            if (lost[at] + loss <= self.needed[at] / 2).all():
                lost[at] += loss
                aside.add(t)
        self.terms = {t: n for n, t in enumerate(sorted(set(postings) - aside))}
        lists = [postings[t] for t in self.terms]
        sizes = np.array([len(at) for at in lists], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        # One end mark behind all lists; a cursor there has left its list.
        self.listed = np.array([*chain.from_iterable(lists), len(items)], np.int64)
        self.impact = np.array([*(self.impacts[i][t] for t, at in zip(self.terms, lists) for i in at), 0.0])
        of = np.repeat(np.arange(len(lists)), sizes)
        self.keys = of * (len(items) + 1) + self.listed[:-1]
        self.n_blocks = -(-len(items) // BLOCK_ITEMS)
        block_keys = of * self.n_blocks + self.listed[:-1] // BLOCK_ITEMS
        self.block_keys, first = np.unique(block_keys, return_index=True)
        self.most = np.maximum.reduceat(self.impact[:-1], first) if len(first) else np.zeros(0)
        self.list_most = np.maximum.reduceat(self.impact[:-1], self.starts[:-1]) if len(lists) else np.zeros(0)
        self.left = self.needed - lost
        self.block_needs = np.array([self.left[i : i + BLOCK_ITEMS].min() for i in range(0, len(items), BLOCK_ITEMS)])
        self.stride = max(len(item.words) for item in items)

    def retrieved(self, numbers: np.ndarray, passage: np.ndarray, counts: Counter | None = None):
        """(passage, item) whose opened terms give what the item needs; ascending.

        ``numbers`` are term numbers and ``passage`` the passages they stand in. ``counts`` takes the number of
        postings in the lists, of those cursors stood on, and of block skips and scored items.
        """
        key = np.unique(passage * len(self.terms) + numbers)
        passage, numbers = key // len(self.terms), key % len(self.terms)
        if counts is not None:
            counts["postings"] += int((self.starts[numbers + 1] - self.starts[numbers]).sum())
        # A passage whose lists' maxima do not reach the easiest need has no pivot.
        names, begin, n = np.unique(passage, return_index=True, return_counts=True)
        hopeful = np.add.reduceat(self.list_most[numbers], begin) >= self.block_needs.min() - 1e-9
        order = np.argsort(n[hopeful], kind="stable")  # passages of about one number of terms together
        names, begin, n = names[hopeful][order], begin[hopeful][order], n[hopeful][order]
        found = []
        for a in range(0, len(names), _PASSAGES_AT_ONCE):
            some = slice(a, a + _PASSAGES_AT_ONCE)
            column = np.arange(n[some].max())
            term = np.where(column < n[some][:, None], numbers[np.minimum(begin[some][:, None] + column, len(numbers) - 1)], -1)
            found += self._walk(names[some], term, counts)
        row, item = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((item, row))
        return row[order], item[order]

    def _walk(self, names: np.ndarray, term: np.ndarray, counts: Counter | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Cursors of the terms (rows, -1 where there is none) from their lists' first items to the last."""
        end, found = len(self.left), []
        at = np.where(term >= 0, self.starts[term], len(self.listed) - 1)
        item = self.listed[at]
        most = np.where(term >= 0, self.list_most[term], 0.0)
        least = self.block_needs.min() - 1e-9
        if counts is not None:
            counts["read"] += int((item < end).sum())
        while len(names):
            order = np.argsort(item, axis=1)
            ordered = np.take_along_axis(item, order, axis=1)
            live = np.where(ordered < end, np.take_along_axis(most, order, axis=1), 0.0)
            reached = np.cumsum(live, axis=1) >= least
            go = reached.any(axis=1)
            names, term, at, item, most = names[go], term[go], at[go], item[go], most[go]
            if not len(names):
                break
            pivot = ordered[go][np.arange(len(names)), reached[go].argmax(axis=1)]
            block = pivot // BLOCK_ITEMS
            upto = item <= pivot[:, None]
            row, col = np.nonzero(upto)
            wanted = term[row, col] * self.n_blocks + block[row]
            place = np.minimum(np.searchsorted(self.block_keys, wanted), len(self.block_keys) - 1)
            maxima = np.where(self.block_keys[place] == wanted, self.most[place], 0.0)
            bound = np.bincount(row, weights=maxima, minlength=len(names))
            skip = bound < self.block_needs[block] - 1e-9
            ready = ~skip & (item.min(axis=1) == pivot)
            if ready.any():
                on = ready[row] & (item[row, col] == pivot[row])
                score = np.bincount(row[on], weights=self.impact[at[row, col]][on], minlength=len(names))
                good = ready & (score >= self.left[pivot] - 1e-9)
                found.append((names[good], pivot[good]))
            beyond = np.where(upto, end, item).min(axis=1)
            target = np.where(skip, np.minimum((block + 1) * BLOCK_ITEMS, beyond), np.where(ready, pivot + 1, pivot))
            move = item[row, col] < target[row]
            row, col = row[move], col[move]
            moved = term[row, col]
            to = np.searchsorted(self.keys, moved * (end + 1) + target[row])
            to = np.where(to < self.starts[moved + 1], to, len(self.listed) - 1)
            at[row, col] = to
            item[row, col] = self.listed[to]
            if counts is not None:
                counts["read"] += int((item[row, col] < end).sum())
                counts["skips"] += int(skip.sum())
                counts["scored"] += int(ready.sum())
        return found

    def leaks(self, texts: list[list[bytes]], containment: float, least_overlap: float) -> Iterator[tuple]:
        """(text, item, score, containment, question overlap, answer overlap, first word) of every leak."""
        if not self.terms:
            return
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        flat = map(self.terms.get, chain.from_iterable(texts), repeat(-1))
        numbers = np.fromiter(flat, np.int64, int(sizes.sum()))
        place = np.flatnonzero(numbers >= 0)
        if not len(place):
            return
        of = np.searchsorted(begins, place, side="right") - 1
        n_passages = sizes // self.stride + 1
        first = np.cumsum(n_passages) - n_passages
        window = (place - begins[of]) // self.stride
        own = first[of] + window
        also = window > 0
        numbers = numbers[place]
        found, items = self.retrieved(
            np.concatenate([numbers, numbers[also]]), np.concatenate([own, own[also] - 1])
        )
        text_of = np.searchsorted(first, found, side="right") - 1
        last = None
        for passage, i, text in zip(found.tolist(), items.tolist(), text_of.tolist()):
            if passage != last:
                last, begin = passage, (passage - int(first[text])) * self.stride
                # Verified on a margin around the passage, where a changed copy may reach.
                inside = set(texts[text][begin : begin + 2 * self.stride])
                low = max(0, begin - self.stride // 2)
                around = texts[text][low : begin + 2 * self.stride + self.stride // 2]
                wide, wide_shingles = set(around), shingles(around)
            score = sum(v for t, v in self.impacts[i].items() if t in inside)
            if score < self.needed[i] - 1e-9:
                continue
            item = self.items[i]
            share = len(item.shingles & wide_shingles) / len(item.shingles)
            if share < containment - 1e-9:
                continue
            if len(next(iter(item.question)).split()) == SHINGLE:
                question = len(item.question & wide_shingles) / len(item.question)
            else:
                asked = next(iter(item.question)).split()
                question = sum(w in wide for w in asked) / len(asked)
            answer = sum(w in wide for w in item.answer) / max(1, len(item.answer))
            if min(question, answer) >= least_overlap - 1e-9:
                yield text, i, score / sum(self.impacts[i].values()), share, question, answer, begin


def build_indexes(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", least_score: float = LEAST_SCORE
) -> Iterator[ItemIndex]:
    """The index in parts of bounded size, with the statistics of all items in each."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t) for t in batch.column("_text").to_pylist()]
        return pa.record_batch(
            {
                "_id": batch.column("_id"),
                "_text": batch.column("_text"),
                "words": pa.array(words, pa.list_(pa.binary())),
            }
        )

    kind = items.schema[id_col].dataType.simpleString()
    split_rows = map_batches(rows, split, f"_id {kind}, _text string, words array<binary>").where(
        F.size("words") >= SHINGLE
    )
    total = split_rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words")).first()
    if not total["n"]:
        return
    terms = split_rows.select(F.explode(F.array_distinct("words")).alias("t"))
    df = terms.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n_parts = math.ceil(total["words"] / PART_WORDS)
    for part in range(n_parts):
        mine = split_rows.where(F.pmod(F.xxhash64("_text"), F.lit(n_parts)) == part)
        own_terms = mine.select(F.explode("words").alias("t")).distinct()
        counts = {bytes(r["t"]): r["df"] for r in df.join(own_terms, "t").collect()}
        found = [Item(r["_id"], r["_text"]) for r in mine.select("_id", "_text").collect()]
        if found:
            found.sort(key=lambda i: (i.words, str(i.id)))
            yield ItemIndex(found, counts, total["n"], total["words"] / total["n"], least_score)


def _batches_of_words(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Texts as words, some at a time, with the number of the first."""
    held, size, start = [], 0, 0
    for number, text in enumerate(texts):
        held.append(words_of(text) if text else [])
        size += len(held[-1])
        if size >= _WORDS_AT_ONCE:
            yield start, held
            held, size, start = [], 0, number + 1
    if held:
        yield start, held


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_score: float = LEAST_SCORE,
    containment: float = CONTAINMENT,
    least_overlap: float = LEAST_OVERLAP,
) -> DataFrame:
    """A row per document and leaked item: ``(id, item, n_passages, score, containment, question_overlap,
    answer_overlap, first_word)``; shares are the best of the passages, scores are shares of the item's own."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    item_type = items.select(item_col).limit(0).toArrow().schema.field(0).type
    schema = (
        f"_id {kind}, item {item_kind}, score double, containment double, question_overlap double, "
        "answer_overlap double, first_word long"
    )
    shares = ("score", "containment", "question_overlap", "answer_overlap")
    out: DataFrame | None = None
    for index in build_indexes(items, item_col, item_text_col, least_score):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index, found = shared.value, []
            for start, texts in _batches_of_words(batch.column("_text").to_pylist()):
                found += [(start + text, *leak) for text, *leak in index.leaks(texts, containment, least_overlap)]
            columns = {"_id": batch.column("_id").take(pa.array([f[0] for f in found], pa.int64()))}
            columns["item"] = pa.array([index.items[f[1]].id for f in found], item_type)
            columns |= {c: pa.array([f[2 + k] for f in found], pa.float64()) for k, c in enumerate(shares)}
            return pa.record_batch(columns | {"first_word": pa.array([f[6] for f in found], pa.int64())})

        part = map_batches(rows, search, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    best = [F.max(c).alias(c) for c in shares]
    grouped = out.groupBy("_id", "item").agg(
        F.count(F.lit(1)).alias("n_passages"), *best, F.min("first_word").alias("first_word")
    )
    return grouped.withColumnsRenamed({"_id": id_col, "item": item_col})


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_score: float = LEAST_SCORE,
    containment: float = CONTAINMENT,
    least_overlap: float = LEAST_OVERLAP,
) -> DataFrame:
    """The rows of ``docs`` that leak no item."""
    for index in build_indexes(items, item_col, item_text_col, least_score):
        docs = docs.where(~_leaks(docs, index, containment, least_overlap)(F.col(text_col)))
    return docs


def _leaks(docs: DataFrame, index: ItemIndex, containment: float, least_overlap: float):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("boolean")
    def leaks(texts):
        hit = np.zeros(len(texts), bool)
        for start, words in _batches_of_words(texts.tolist()):
            hit[[start + leak[0] for leak in shared.value.leaks(words, containment, least_overlap)]] = True
        return pd.Series(hit)

    return leaks
