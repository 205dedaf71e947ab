"""Benchmark decontamination: shared n-grams find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, texts

U64 = np.uint64
WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000  # words of test items that go to every task at once, about 32 bytes each; more items are taken in more blocks
FILTER_BITS = 24
KEPT_WORDS = 400_000  # words whose hashes a task remembers


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Code(dict):
    """64-bit hash of a word (text, or its bytes), remembered."""

    def __missing__(self, word: str | bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 7)
        return h

    def __call__(self, found: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring word hashes, in order."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return h


def align(passage: tuple[str, ...], item: tuple[str, ...]) -> int:
    """Best Smith-Waterman score of a local alignment of words."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
    return aligned(np.array([ids.get(w, -1) for w in passage], np.int32), np.array([ids[w] for w in item], np.int32))


def aligned(passage: np.ndarray, item: np.ndarray) -> int:
    """align() of word numbers; words that the item does not hold are -1."""
    reach = GAP * np.arange(len(item) + 1)
    row, best = np.zeros(len(item) + 1, np.int64), 0
    for w in passage.tolist():
        step = np.where(item == w, MATCH, MISMATCH)
        new = np.zeros(len(item) + 1, np.int64)
        np.maximum(row[:-1] + step, row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - reach) + reach  # gaps along the item
        best = max(best, int(row.max()))
    return best


def arrays(rows: list[tuple[int | None, np.ndarray]], n: int) -> SimpleNamespace:
    """A block of test items (name, word hashes): names, all word hashes and the first of each item, the grams sorted with item and place, and the gram sizes that occur."""
    grams = [gram_hashes(w, min(n, len(w))) for _, w in rows]
    count = [len(g) for g in grams]
    gram, item, place = np.concatenate(grams), np.repeat(np.arange(len(rows), dtype=np.int32), count), np.concatenate([np.arange(c, dtype=np.int32) for c in count])
    o = np.argsort(gram, kind="stable")
    return SimpleNamespace(names=[i for i, _ in rows], words=np.concatenate([w for _, w in rows]), first=np.append(0, np.cumsum([len(w) for _, w in rows])), gram=gram[o], item=item[o], place=place[o], sizes=sorted({min(n, len(w)) for _, w in rows}))


def seeds(items: SimpleNamespace, w: np.ndarray, ends: np.ndarray, passes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, diagonal) of every gram that rows share with items; row i has the words w[ends[i - 1]:ends[i]]."""
    rows, at_item, diagonal = [], [], []
    starts = np.append(0, ends[:-1])
    for n in items.sizes:
        h = gram_hashes(w, n)
        at = np.flatnonzero(passes[h >> U64(64 - FILTER_BITS)])
        lo = np.searchsorted(items.gram, h[at])
        same = items.gram[np.minimum(lo, len(items.gram) - 1)] == h[at]
        at, lo = at[same], lo[same]
        row = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[row]
        at, lo, row = at[inside], lo[inside], row[inside]
        many = np.searchsorted(items.gram, h[at], side="right") - lo
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        rows.append(np.repeat(row, many))
        at_item.append(items.item[which])
        diagonal.append(np.repeat(at - starts[row], many) - items.place[which])
    return np.concatenate(rows), np.concatenate(at_item), np.concatenate(diagonal)


def scored(docs: DataFrame, items: SimpleNamespace, n: int, threshold: float, slack: float) -> DataFrame:
    """(keys, item_id, score, n_seeds) of the aligned pairs at or over the threshold, from (keys, text); item_id is the item's name.

    Every gram that a row shares with an item is a seed. Diagonals at most `slack` of the item's length apart are aligned as one
    passage, unless the words it shares with the item are too few for the threshold in any order. The items travel as a broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.drop("text").schema.add("item_id", "long").add("score", "double").add("n_seeds", "long")

    def run(batches):
        items, code = sent.value, Code()
        passes = np.zeros(1 << FILTER_BITS, bool)
        passes[items.gram >> U64(64 - FILTER_BITS)] = True

        @lru_cache(maxsize=5_000)
        def numbered(item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(different words sorted, the item in their numbers, how often each occurs)"""
            different, numbers, count = np.unique(items.words[items.first[item] : items.first[item + 1]], return_inverse=True, return_counts=True)
            return different, numbers.astype(np.int32), count

        best_of = lru_cache(maxsize=20_000)(lambda passage, item: aligned(np.frombuffer(passage, np.int32), numbered(item)[1]))

        def best(w: np.ndarray, item: int, diagonals: np.ndarray) -> float:
            different, numbers, count = numbered(item)
            size = len(numbers)
            more = int(size * slack) + 1
            cut = [0, *(np.flatnonzero(diagonals[1:] > diagonals[:-1] + more) + 1).tolist(), len(diagonals)]
            top = 0
            for i, j in zip(cut, cut[1:]):
                part = w[max(0, int(diagonals[i]) - more) : int(diagonals[j - 1]) + size + 2 * more]
                k = np.minimum(np.searchsorted(different, part), len(different) - 1)
                passage = np.where(different[k] == part, k, -1).astype(np.int32)
                shared = np.minimum(np.bincount(passage[passage >= 0], minlength=len(count)), count).sum()
                if shared >= threshold * size:
                    top = max(top, best_of(passage.tobytes(), item))
            return top / (MATCH * size)

        for b in batches:
            found = [code(words(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            w, ends = np.concatenate(found) if found else np.empty(0, np.uint64), np.cumsum([len(x) for x in found], dtype=np.int64)
            row, item, diagonal = seeds(items, w, ends, passes)
            o = np.lexsort((diagonal, item, row))
            row, item, diagonal = row[o], item[o], diagonal[o]
            cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])))[: len(row)]
            out: list[tuple] = []
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(row)]):
                r, it = int(row[i]), int(item[i])
                score = best(found[r], it, diagonal[i:j])
                if score >= threshold:
                    out.append((r, items.names[it], score, j - i))
            at = pa.array([r for r, *_ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), *(pa.array([x[i] for x in out], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64())))], kind.names)

    return docs.mapInArrow(run, kind)


def blocks(bench: DataFrame, n: int) -> Iterator[SimpleNamespace]:
    """The different test items in blocks of at most about BLOCK_WORDS words, one at a time; items without words are none."""
    held: list[tuple[int | None, np.ndarray]] = []
    size, code = 0, Code()
    for r in bench.dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        w = code(words(r.text))
        if held and size + len(w) > BLOCK_WORDS:
            yield arrays(held, n)
            held, size = [], 0
        if len(w):
            held.append((r.item_id, w))
            size += len(w)
    if held:
        yield arrays(held, n)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.6, slack: float = 0.25, keys: list[str] | None = None) -> DataFrame:
    """(doc_id, item_id, score, n_seeds): passages of a row that align with a test item at `threshold` of the item's own score or more.

    Words are runs of letters, digits and underscores, in lower case, known by their 64-bit hashes. The score is the best local
    alignment's (2 for equal words, -1 for others and gaps), divided by that of the item with itself. Rows are aligned with every
    item of which they hold `n` words in a row (all words of a shorter item); n_seeds counts those places. Different texts under
    one item id, or under none, are items of their own, each reported with that id; null and empty texts match nothing; repeated
    rows are reported once for each. A row with a null doc_id is reported with it. Other columns are dropped; an empty table gives
    an empty table. Whole texts of any length are searched. `keys` are columns to report instead of doc_id.
    """
    docs = texts(df, id_col, text_col) if keys is None else df.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    parts = [materialize(scored(docs, items, n, threshold, slack), "leaks") for items in blocks(bench, n)]
    if not parts:
        return docs.sparkSession.createDataFrame([], docs.drop("text").schema.add("item_id", "long").add("score", "double").add("n_seeds", "long"))
    while len(parts) > 1:  # a plan of few parts, however many blocks there are
        some, parts = parts[:50], parts[50:]
        out = some[0]
        for p in some[1:]:
            out = out.union(p)
        if parts:
            out = materialize(out, "leaks")
            discard(*some)
        parts = [*parts, out] if parts else [out]
    return parts[0]
