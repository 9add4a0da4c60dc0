"""Packing of tokenised documents into sequences by order-preserving dynamic programming.

The documents of a partition are one stream of ids in their stored order. Windows may be cut at the
end of a document (free), at the end of a sentence (``SENTENCE_PENALTY``) or of a clause
(``CLAUSE_PENALTY``) or, where those are more than a window apart, between them (``HARD_PENALTY``). With v(j) = cost(j) + position(j) the recurrence
cost(j) = min over i within a window of cost(i) + padding(i, j) + penalty(j) becomes
v(j) = min v(i) + window + penalty(j), a sliding minimum that a monotone queue gives in constant time.

The stream is solved in blocks of documents; the last window of a block stays open and starts the next
block, so blocks add no padding. What is left at the end of a partition is laid into sequences whose
lengths are powers of two, which need no padding. Nothing is shuffled: a partition writes its own
sequences, numbered ``partition * 2^33 + n``.

Cases: a null or empty text is one piece of length 1, the closing id; a text longer than a window
becomes several pieces; equal ids and repeated rows are packed as rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SENTENCE_PENALTY = 8
CLAUSE_PENALTY = 16
HARD_PENALTY = 256
# Ids gathered before windows are chosen; a bound on memory, not on documents.
BLOCK_TOKENS = 1 << 20
# Units of words a worker remembers; one that the vocabulary has to encode costs many times a hit.
_HELD_UNITS = 1_000_000
# Texts whose words are told apart at once, in bytes; a longer text is taken alone.
CHUNK_BYTES = 2 << 20
_LOWER = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_CLOSING = ".,;:!?"
_PLAIN = f"^[{_LETTERS}]+[{_CLOSING}]*$"
_STEM = f"^[{_LETTERS}]+"
_SENTENCE_END = "[.!?]$"
_CLAUSE_END = "[,;:]$"


class WordEncoder:
    """Ids of whole texts from the ids of their words.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its
    words one after another. Plain letters with closing punctuation are two units to the vocabulary,
    which folds case: those share their letters. Each unit is encoded once while it stays in the table;
    letters go straight to the vocabulary's merges, where its normaliser and splitter leave them whole.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.letters = _letter_names(self.tokenizer)
        self.reset()

    def reset(self) -> None:
        self.units = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, new: list[str], encoded: list[list[int]]) -> None:
        n = len(self.units)
        self.units.update(zip(new, range(n, n + len(new))))
        lengths = np.fromiter(map(len, encoded), np.int64, len(new))
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum()))
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts, self.lengths = _room(self.starts, n + len(new)), _room(self.lengths, n + len(new))
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(new)] = lengths
        self.starts[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)

    def _numbers(self, units: list[str], letters: bool = False) -> np.ndarray:
        """The places of different ``units`` in the table; ``letters`` are lower-case runs of ``_LETTERS``."""
        known = self.units
        new = [unit for unit in units if unit not in known]
        if new and letters and self.letters:
            names, tokenize = self.letters, self.model.tokenize
            spelt = (unit if unit.isascii() else unit.translate(names) for unit in new)
            self._add(new, [[token.id for token in tokenize(unit)] for unit in spelt])
        elif new:
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self._add(new, [e.ids for e in encoded])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, lengths, prices)``: ids of different ``words`` side by side, prices of a cut behind each."""
        prices = np.where(_mask(words, _SENTENCE_END), SENTENCE_PENALTY, CLAUSE_PENALTY * _mask(words, _CLAUSE_END))
        plain = _mask(words, _PLAIN)
        closed = plain & (prices > 0)
        first, behind = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        first[~plain] = self._numbers(_strings(words.filter(pa.array(~plain))))
        stems = pc.utf8_rtrim(pc.utf8_lower(words.filter(pa.array(plain))), _CLOSING).dictionary_encode()
        first[plain] = self._numbers(_strings(stems.dictionary), letters=True)[stems.indices.to_numpy()]
        tails = pc.replace_substring_regex(words.filter(pa.array(closed)), _STEM, "").dictionary_encode()
        behind[closed] = self._numbers(_strings(tails.dictionary))[tails.indices.to_numpy()]
        pairs = np.column_stack([first, behind])
        lengths = self.lengths[pairs].sum(axis=1)
        ids = _runs(self.flat, self.starts[pairs.ravel()], self.lengths[pairs.ravel()])
        return ids, np.cumsum(lengths) - lengths, lengths, prices

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text, null as empty: its ids, and (position, price) behind the words that end a sentence or a clause."""
        if len(self.units) > _HELD_UNITS:
            self.reset()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        flat, starts, lengths, prices = self._words(words.dictionary)
        ids = _runs(flat, starts[at], lengths[at])
        behind = np.concatenate([[0], np.cumsum(lengths[at])])
        prices = prices[at]
        marked = np.flatnonzero(prices)
        marks = np.column_stack([behind[marked + 1], prices[marked]])
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        mark_edges = np.searchsorted(marked, edges)
        for i in range(len(texts)):
            low, high = behind[edges[i]], behind[edges[i + 1]]
            yield ids[low:high], marks[mark_edges[i] : mark_edges[i + 1]] - (low, 0)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return next(self.encode(pa.array([text])))


def _letter_names(tokenizer: Tokenizer) -> dict[int, str]:
    """How the splitter spells each of ``_LOWER``.

    Empty, so that all is left to the whole tokenizer, unless it folds letters one by one, keeps runs of
    them whole and has no added token of letters.
    """
    normalizer, splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
    if normalizer is None or splitter is None:
        return {}

    def spelt(text: str) -> list[str]:
        return [piece for piece, _ in splitter.pre_tokenize_str(text)]

    names = {ord(c): "".join(spelt(c)) for c in _LOWER}
    runs = (_LOWER, _LOWER[::-1])
    folded = normalizer.normalize_str(_UPPER + _LOWER) == _UPPER.lower() + _LOWER
    whole = all(spelt(run) == [run.translate(names)] for run in runs) and all(names[ord(c)] == c for c in _LOWER[:26])
    added = any(token.content.isalpha() for token in tokenizer.get_added_tokens_decoder().values())
    return names if folded and whole and not added else {}


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _mask(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)


def _runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of all runs, one behind the other."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return values[at]


def _room(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(size, 2 * len(values)) - len(values), values.dtype)])


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with some ``size`` bytes of texts, one row at least."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


@lru_cache(maxsize=2)
def word_encoder(file: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already fills the cores
    return WordEncoder(file)


def choose_cuts(positions: list[int], penalties: list[int], window: int) -> list[int]:
    """Cheapest ends of windows, ascending.

    ``positions`` are the places where a cut is allowed, ascending and at most ``window`` apart,
    from 0 to the end of the stream; ``penalties`` has the price of each.
    """
    back = [0] * len(positions)
    value = [0] * len(positions)
    queue = deque([0])
    for j in range(1, len(positions)):
        least = positions[j] - window
        while positions[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        v = value[j] = value[i] + window + penalties[j]
        back[j] = i
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(positions) - 1
    while j:
        cuts.append(positions[j])
        j = back[j]
    return cuts[::-1]


def cut_places(ends: np.ndarray, marks: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Allowed cuts with prices: ends of documents, the priced ``marks``, and steps through long gaps."""
    # Stable order and the first of equal places: an end of a document is free whatever ends there.
    at = np.concatenate([[0], ends, marks[:, 0]])
    price = np.concatenate([np.zeros(len(ends) + 1, np.int64), marks[:, 1]])
    edges, first = np.unique(at, return_index=True)
    price = price[first]
    gaps = np.diff(edges)
    steps = [np.arange(edges[k] + window, edges[k + 1], window) for k in np.flatnonzero(gaps > window)]
    if steps:
        hard = np.concatenate(steps)
        order = np.argsort(np.concatenate([edges, hard]), kind="stable")
        edges = np.concatenate([edges, hard])[order]
        price = np.concatenate([price, np.full(len(hard), HARD_PENALTY)])[order]
    return edges.tolist(), price.tolist()


def powers_of_two(length: int) -> list[int]:
    """Lengths of sequences, each a power of two, that hold ``length`` ids."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class _Packer:
    def __init__(self, first_sequence: int, window: int):
        self.sequence, self.window = first_sequence, window
        self.docs: list[tuple[object, int, np.ndarray, np.ndarray, int]] = []
        self.held = 0

    def add(self, key, ids: np.ndarray, marks: np.ndarray) -> None:
        self.docs.append((key, 0, ids, marks, len(ids)))
        self.held += len(ids)

    def solve(self, last: bool) -> dict[str, list]:
        """The pieces of all closed windows; unless ``last``, the final window stays."""
        out: dict[str, list] = {c: [] for c in ("id", "start", "length", "crc", "tokens", "sequence", "offset")}
        if not self.docs:
            return out
        lengths = np.array([len(d[2]) for d in self.docs])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        marks = np.concatenate([d[3] + (b, 0) for d, b in zip(self.docs, begins)])
        cuts = choose_cuts(*cut_places(ends, marks, self.window), self.window)
        before = cuts[-2] if len(cuts) > 1 else 0
        if last:
            tail = cuts[-1] - before
            if tail & (tail - 1):
                cuts[-1:] = (before + np.cumsum(powers_of_two(tail))).tolist()
        else:
            cuts.pop()
        d, at = 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                key, start, ids, _, total = self.docs[d]
                low = at - int(begins[d])
                high = min(len(ids), cut - int(begins[d]))
                row = (key, start + low, high - low, zlib.crc32(ids[low:high].tobytes()), total, self.sequence, offset)
                for values, value in zip(out.values(), row):
                    values.append(value)
                offset += high - low
                at += high - low
                if high == len(ids):
                    d += 1
            self.sequence += 1
        rest = []
        for (key, start, ids, marks, total), begin in zip(self.docs[d:], begins[d:]):
            low = max(0, at - int(begin))
            rest.append((key, start + low, ids[low:], marks[marks[:, 0] > low] - (low, 0), total))
        self.docs = rest
        self.held = sum(len(r[2]) for r in rest)
        return out


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    file = tokenizer_file or public_tokenizers.path("word_bpe_49k.json")
    name = Path(file).name
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(file if Path(file).exists() else public_tokenizers.path(name)).encode
        packer = _Packer(TaskContext.get().partitionId() << 33, window)
        id_type = None

        def table(pieces: dict[str, list]) -> pa.RecordBatch:
            longs = {"start": "start", "length": "length", "ids_crc32": "crc", "doc_tokens": "tokens"}
            columns = {id_col: pa.array(pieces["id"], id_type)}
            columns |= {n: pa.array(pieces[k], pa.int64()) for n, k in longs.items()}
            columns |= {"sequence_id": pa.array(pieces["sequence"], pa.int64())}
            return pa.record_batch(columns | {"offset": pa.array(pieces["offset"], pa.int64())})

        for batch in chunks(batches, CHUNK_BYTES):
            id_type = batch.column("_id").type
            for key, (ids, marks) in zip(batch.column("_id").to_pylist(), encode(batch.column("_text"))):
                packer.add(key, np.append(ids, np.uint32(end_id)), marks)
                if packer.held >= BLOCK_TOKENS:
                    yield table(packer.solve(last=False))
        if packer.docs:
            yield table(packer.solve(last=True))

    schema = (
        f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
