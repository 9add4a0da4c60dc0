"""Spelling variants of a corpus: words one edit apart, grouped under their commonest near word.

Words are counted over all texts, first inside each task, then in Spark. Two words are near if one code
point inserted, deleted or replaced makes them equal. Such an edit leaves the first half or the rest of
the shorter word's length untouched, so every word is placed in the units of its halves: for a shorter
length ``s`` the words of length ``s`` and ``s + 1`` that share the first ``s // 2`` code points, or the last
``s - s // 2``. Inside a unit words are rows of a padded code-point matrix; blocks of rows are compared
pair by pair, position by position, for their common prefix and, from the end, their common suffix. The
two lengths reach the longer length minus one exactly for single edits. A pair found by its prefix is
left out of the suffix units, so every pair counts once.

Units over ``BLOCK_CELLS`` code points are dealt into blocks and pairs of blocks are the units Spark
shuffles: no unit outgrows two blocks, however common a half is. A tile returns per word the number of its
near words and the best of them, never the pairs.

Cases: a null text has no words; a null id counts as an empty one; a text of any length is one row;
repeated rows count again; of equally common near words the first in code-point order wins; an empty
table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import byte_texts, slices
from weekloom.session import write_table

MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
RATE = 199
# Code points of one block; words shorter than 64 count as 64, so a block has at most 2,048 rows.
BLOCK_CELLS = 1 << 17
# A task's counts are handed on at this many words, which bounds its memory whatever the vocabulary.
HELD_WORDS = 300_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def runs_of(text: bytes, least: int) -> list[str]:
    """Maximal runs of at least ``least`` letters, A-Z lower-cased."""
    pattern = _PATTERNS.get(least) or _PATTERNS.setdefault(least, re.compile(f"[a-zÀ-ÿ]{{{least},}}"))
    return pattern.findall(text.translate(_LOWER).decode("utf-8", "replace"))


_PATTERNS: dict[int, re.Pattern] = {}


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: int = RATE,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """``(word, n)`` of the words that occur ``min_count`` times or more.

    A run whose checksum with the document's id is a multiple of ``rate`` loses one code point.
    """

    def flush(held: Counter) -> pa.RecordBatch:
        batch = pa.record_batch(
            {"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())}
        )
        held.clear()
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in slices(batches):
            for key, text in zip(part.column("_id").to_pylist(), byte_texts(part.column("_text"))):
                salt = zlib.crc32(f"{'' if key is None else key}:".encode())
                # A run only gets shorter, so those below the length never matter.
                for word, n in Counter(runs_of(text, min_length)).items():
                    h = zlib.crc32(word.encode(), salt)
                    if h % rate == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield flush(held)
        yield flush(held)

    own = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    counts = own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def _placed(words: DataFrame) -> DataFrame:
    """``(unit, prefix, s, side, word, n)``: every word in the units of its halves, large units in block pairs."""
    size = F.char_length("word")
    places = []
    for s in (size, size - 1):
        half = F.floor(s / 2).cast("int")
        places.append(F.struct(s.alias("s"), F.lit(True).alias("prefix"), F.substring("word", F.lit(1), half).alias("part")))
        rest = F.substring("word", size - (s - half) + 1, s - half)
        places.append(F.struct(s.alias("s"), F.lit(False).alias("prefix"), rest.alias("part")))
    rows = words.select("word", "n", F.inline(F.array(*places))).where("s > 0")
    cells = F.count(F.lit(1)) * F.greatest(F.first("s") + 1, F.lit(64))
    parts = rows.groupBy("s", "prefix", "part").agg(F.ceil(cells / BLOCK_CELLS).alias("parts")).where("parts > 1")
    dealt = rows.join(write_table(parts, "large-units"), ["s", "prefix", "part"], "left").fillna(1, ["parts"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select(
        F.concat_ws(":", "s", F.col("prefix").cast("int"), low, high, "part").alias("unit"),
        "prefix",
        "s",
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        "word",
        "n",
    )


def _matrix(words: list[str], width: int) -> np.ndarray:
    """One row of code points per word, padded to ``width``."""
    flat = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    cells = np.frombuffer(flat, np.uint32).reshape(len(words), width)
    return cells.astype(np.uint8) if not cells.size or cells.max() < 256 else cells


def common_lengths(a: np.ndarray, b: np.ndarray, known: int, width: int) -> np.ndarray:
    """Length of the common prefix, at most ``width``, of every row of ``a`` with every row of ``b``.

    The first ``known`` positions are equal throughout.
    """
    length = np.full((len(a), len(b)), known, np.int32)
    alive = np.ones((len(a), len(b)), bool)
    for k in range(known, width):
        alive &= a[:, k, None] == b[None, :, k]
        if not alive.any():
            break
        length += alive
    return length


class _Side:
    """Words of one length, the commonest first, as matrices read from either end."""

    def __init__(self, words: list[str], n: list[int], width: int):
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.words, self.n = [words[i] for i in order], [n[i] for i in order]
        self.forward = _matrix(self.words, width)
        self.backward = _matrix([w[::-1] for w in self.words], width)


def near_tile(a: _Side, b: _Side, s: int, longer: int, prefix: bool) -> np.ndarray:
    """Which words of ``a``, of length ``s``, are one edit from which of ``b``, of length ``longer``."""
    half = s // 2
    front = common_lengths(a.forward, b.forward, half if prefix else 0, s)
    back = common_lengths(a.backward, b.backward, 0 if prefix else s - half, s)
    near = front + back >= longer - 1
    return near if prefix else near & (front < half)


def _unit_rows(s: int, prefix: bool, side: list[int], words: list[str], n: list[int]) -> Iterator[tuple]:
    """``(word, n_near, best_n, best)`` of one unit; a word may come several times."""
    groups: dict[tuple[int, bool], list[int]] = {}
    for i, (at, word) in enumerate(zip(side, words)):
        groups.setdefault((at, len(word) > s), []).append(i)
    sides = {g: _Side([words[i] for i in rows], [n[i] for i in rows], s + 1) for g, rows in groups.items()}
    two = any(at for at, _ in sides)
    tiles = [((0, False), (0, False)), ((0, False), (0, True))]
    if two:
        tiles = [((0, False), (1, False)), ((0, False), (1, True)), ((1, False), (0, True))]
    for x, y in tiles:
        if x not in sides or y not in sides:
            continue
        a, b = sides[x], sides[y]
        near = near_tile(a, b, s, s + y[1], prefix)
        if x == y:
            np.fill_diagonal(near, False)
        ways = ((a, b, near),) if x == y else ((a, b, near), (b, a, near.T))
        for own, others, found in ways:
            count = found.sum(axis=1)
            best = found.argmax(axis=1)
            for i in np.flatnonzero(count).tolist():
                j = int(best[i])
                yield own.words[i], int(count[i]), others.n[j], others.words[j]


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``words(word, n)`` that have a near word."""
    rows = _placed(words).repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tiles(table: pa.Table) -> pa.RecordBatch:
            units = table.column("unit").combine_chunks().dictionary_encode()
            units = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
            units = units.indices.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1], [True]]))
            found = []
            for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if last - first > 1:
                    mine = table.slice(first, last - first)
                    columns = (mine.column(c).to_pylist() for c in ("side", "word", "n"))
                    found += _unit_rows(mine.column("s")[0].as_py(), mine.column("prefix")[0].as_py(), *columns)
            columns = zip(*found) if found else ((), (), (), ())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            names = ("word", "n_near", "best_n", "best")
            return pa.record_batch({c: pa.array(list(v), k) for c, v, k in zip(names, columns, kinds)})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cut = pa.compute.index(table.column("unit"), table.column("unit")[-1]).as_py()
            if cut:  # the last unit may go on in the next batch
                yield tiles(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield tiles(pa.Table.from_batches(held))

    found = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.minus")).alias("best_n"), F.col("first.best").alias("best")
    )


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of ``links(word, form)``: forms followed to the end, twice as far in each round.

    A form is several times as common as its word, so there are no circles.
    """
    now = write_table(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next")
        moved = write_table(moved, "roots")
        if not moved.where("_next IS NOT NULL").take(1):
            return moved.drop("_next")
        now = moved.drop("_next")


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rate: int = RATE,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    factor: int = FACTOR,
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of the corpus.

    ``form`` is the commonest near word where it is at least ``factor`` (two or more) times as common,
    ``root`` the word at which the forms that follow end.
    """
    words = write_table(word_counts(docs, id_col, text_col, rate, min_length, min_count), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= factor * F.col("n")
    formed = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    formed = write_table(formed, "forms")
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    whole = formed.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
