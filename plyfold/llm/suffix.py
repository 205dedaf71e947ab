"""Exact removal of repeated byte strings.

A byte goes if a string of `length` bytes that covers it also starts earlier in the corpus. Texts meet at anchors: of the grams
in a window of `length` bytes, the one with the smallest hash, so that equal windows have equal anchors at equal places. Only
the surroundings of anchors that occur more than once are compared, by a column-wise construction over the whole collection of
them: each round inserts one symbol of every string, last symbols first, and updates the order of the suffixes (with it the
Burrows-Wheeler transform) and the common prefixes of neighbours. The transform and the common prefixes of every round are
written one after the other to a table in the shared folder, with the repeats that they show.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, binary_parts, discard, materialize, partitions, spans, texts

U64 = np.uint64
GRAM = 32
CHUNK = 512 << 10  # bytes hashed at once; twice as many are under 2 ** 24, as places in a chunk take 24 bits
SEEN = 64  # contexts of a hot anchor that the sample should hold
MOST_HOT = 100_000  # hot anchors that go to every task


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of every number."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Powers:
    """Random byte values, and powers of an odd base and of its inverse modulo 2 ** 64, for chunks of up to n bytes."""

    def __init__(self, n: int):
        rng = np.random.default_rng(20_240_229)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.up, self.down = (np.cumprod(np.append(U64(1), np.full(n, x, np.uint64)), dtype=np.uint64) for x in (U64(base % (1 << 64)), U64(pow(base, -1, 1 << 64))))


class Rolling:
    """Hashes of any substring of a chunk in constant time: a sum of random byte values times powers of an odd base, modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, powers: Powers):
        self.up = powers.up
        self.sum = np.empty(len(data) + 1, np.uint64)
        self.sum[0] = 0
        np.multiply(powers.value[data], powers.down[: len(data)], out=self.sum[1:])
        np.cumsum(self.sum, out=self.sum)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sum[end] - self.sum[start]) * self.up[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sum) - k
        return mixed((self.sum[k:] - self.sum[:n]) * self.up[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from minima of prefixes and suffixes of blocks of w."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, powers: Powers, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, gram hash, context hash, anchor, first start, last start) of every anchor of the rows data[offs[i]:offs[i+1]].

    Places are relative to the row. The windows that start from the first to the last start have this anchor; the context is
    their bytes, and its hash also takes in where the anchor is. An anchor whose hash is in `hot` (sorted) comes once for each of
    its windows instead, under a hash of that window: a context as short as can be, which no other context shares a hash with.
    """
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    lo, data = int(offs[0]), data[offs[0] : offs[-1]]
    offs = offs - lo
    if len(data) < length:
        return none
    roll = Rolling(data, powers)
    low = U64((1 << 24) - 1)
    key = roll.grams(GRAM)
    key &= ~low
    key |= np.arange(len(key), dtype=np.uint64)
    at = (sliding_min(key, length - GRAM + 1) & low).astype(np.int32)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + length <= offs[row + 1]).astype(np.int32)
    if not len(start):
        return none
    at, row = at[start], row[start]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
    first, last = np.append(0, cut + 1), np.append(cut, len(start) - 1)
    at, row, first, last = (x.astype(np.int64) for x in (at[first], row[first], start[first], start[last]))
    h = roll(at, at + GRAM)
    if len(hot):
        split = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        n = np.where(split, last - first + 1, 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, row, first, last, h, split = (np.repeat(x, n) for x in (at, row, first, last, h, split))
        first = first + nth
        last = np.where(split, first, last)
    ctx = mixed(roll(first, last + length) + (at - first).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    if len(hot):
        h = np.where(split, mixed(ctx ^ h ^ U64(0xA0761D6478BD642F)), h)
    return row, h, ctx, at - offs[row], first - offs[row], last - offs[row]


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, sorted, with neighbours that touch made one."""
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1))[: len(doc)]
    i = np.flatnonzero(new)
    return doc[i], lo[i], np.maximum.reduceat(hi, i) if len(i) else hi


PLACED = "h long, ctx long, doc_id long, lo int, hi int, at int"


def placed(docs: DataFrame, length: int, hot: np.ndarray, most: int = 400_000) -> DataFrame:
    """Anchors of (doc_id, text bytes), already reduced inside each task; see anchors() for those in `hot`.

    Of equal anchors with equal contexts in a task all that don't stand where the earliest does are certain repeats: they come out merged, as ranges of
    starts with at = -1 and a hash of their own, so a group of copies adds one row per task and not one per copy.
    """

    def batch(cols):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "ctx", "doc_id", "lo", "hi", "at"])

    def reduced(held):
        doc, h, ctx, at, lo, hi = (np.concatenate(x) for x in zip(*held))
        o = np.lexsort((lo, doc, ctx, h))
        doc, h, ctx, at, lo, hi = (x[o] for x in (doc, h, ctx, at, lo, hi))
        k = np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))
        lead = np.flatnonzero(k)[np.cumsum(k) - 1]
        again = (doc != doc[lead]) | (lo != lo[lead])
        yield batch([h[k].view(np.int64), ctx[k].view(np.int64), doc[k], lo[k].astype(np.int32), hi[k].astype(np.int32), at[k].astype(np.int32)])
        d, a, b = merged(doc[again], lo[again], hi[again])
        if len(d):
            own = mixed(d.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + a.astype(np.uint64)).view(np.int64)
            yield batch([own, own, d, a.astype(np.int32), b.astype(np.int32), np.full(len(d), -1, np.int32)])

    def run(batches):
        held, size, powers = [], 0, Powers(2 * CHUNK + length)
        for b in batches:
            ids, (raw, offs) = b.column(0).to_numpy(zero_copy_only=False), binary_parts(b.column(1))
            for i, j in spans(offs, CHUNK):
                for part, o, base in pieces(raw, offs[i : j + 1], length):
                    row, h, ctx, at, lo, hi = anchors(part, o, length, powers, hot)
                    held.append((ids[i + row], h, ctx, at + base, lo + base, hi + base))
                    size += len(row)
            if size >= most:
                yield from reduced(held)
                held, size = [], 0
        if size:
            yield from reduced(held)

    return docs.filter("doc_id is not null").mapInArrow(run, PLACED)


def hot_anchors(docs: DataFrame, length: int, hot: int) -> np.ndarray:
    """Sorted hashes of the anchors that have over about `hot` different contexts, from a sample of rows.

    It only decides how finely the contexts of an anchor are cut, not what is found: any set gives the same result. The sample
    is so large that such an anchor should be in it SEEN times; half as many count. At most MOST_HOT come back, the hottest.
    """
    share = SEEN / hot
    some = docs.sample(share, seed=11) if share < 1 else docs
    met = placed(some, length, np.empty(0, np.uint64)).filter("at >= 0").groupBy("h").agg(F.count("*").alias("n"), F.approx_count_distinct("ctx").alias("kinds"))
    found = met.filter((F.col("n") >= SEEN // 2) & (F.col("kinds") >= SEEN // 2)).orderBy(F.desc("kinds"), "h").limit(MOST_HOT)
    return np.sort(np.array([r.h for r in found.select("h").collect()], np.int64).view(np.uint64))


def pieces(raw: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, row offsets, place of the piece in its row): all rows at once, or one very long row in pieces that share length - 1 bytes."""
    n = int(offs[-1] - offs[0])
    if n <= 2 * CHUNK:
        yield raw, offs, 0
        return
    for a in range(0, n - length + 1, CHUNK):
        yield raw, offs[0] + np.array([a, min(n, a + CHUNK + length - 1)]), a


def column_wise(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Build order and common prefixes of the suffixes of many equally long strings (a row each), a column each round from the right.

    Yields (column, order, lcp, transform) after each round: the rows sorted by what they hold from that column on, the number
    of symbols (255 at most) that each shares with the one before it, and the symbols before the sorted suffixes, which are the
    round's part of the collection's Burrows-Wheeler transform (zero before the first column). A stable sort by the new symbol,
    which the last round's transform gives in order, keeps the old order inside a symbol; neighbours with equal symbols share
    one more than the least of the old values between them.
    """
    n, width = symbols.shape
    columns = np.ascontiguousarray(symbols.T)
    order = np.arange(n)
    lcp, before = np.zeros(n, np.uint8), columns[-1]
    for c in range(width - 1, -1, -1):
        by = np.argsort(before, kind="stable")
        sym = before[by]
        same = np.append(False, sym[1:] == sym[:-1])
        if c == width - 1:
            new = same.astype(np.uint8)
        else:
            gap = by - np.append(0, by[:-1])
            least = np.zeros(n, np.uint8)
            one = same & (gap == 1)
            least[one] = lcp[by[one]]
            rest = np.flatnonzero(same & (gap > 1))
            level, cur, k = np.zeros(len(rest), np.int64), lcp, 0
            if len(rest):
                level = np.int64(np.floor(np.log2(gap[rest])))
                todo = level.max()
                while True:
                    at = rest[level == k]
                    if len(at):
                        hi, lo = by[at], by[at] - gap[at] + 1
                        least[at] = np.minimum(cur[lo], cur[hi - (1 << k) + 1])
                    if k == todo:
                        break
                    cur, k = np.minimum(cur[: -(1 << k)], cur[1 << k :]), k + 1
            new = np.where(same, np.minimum(least, 254) + 1, 0).astype(np.uint8)
        order, lcp = order[by], new
        before = columns[c - 1][order] if c else np.zeros(n, np.uint8)
        yield c, order, lcp, before


def laid_out(at: np.ndarray, lo: np.ndarray, context: pa.Array, length: int) -> np.ndarray:
    """A row of symbols for each context, laid out around its anchor, so that equal windows stand in the same columns."""
    raw, offs = binary_parts(context)
    pad = length - GRAM
    rows = np.zeros((len(at), pad + length), np.uint8)
    size = np.diff(offs)
    begin = np.arange(len(at)) * rows.shape[1] + pad - (at - lo)
    rows.reshape(-1)[np.repeat(begin - (offs[:-1] - offs[0]), size) + np.arange(offs[-1] - offs[0])] = raw[offs[0] : offs[-1]]
    return rows


def repeats(doc: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: pa.Array, length: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, bytes, bytes]]]:
    """((doc, lo, hi) ranges of starts whose window also starts earlier in one of the contexts, rounds (column, transform, lcp))."""
    pad = length - GRAM
    rank = np.empty(len(doc), np.int64)
    o = np.lexsort((at, doc))
    rank[o] = np.cumsum(np.append(0, (doc[o][1:] != doc[o][:-1]) | (at[o][1:] != at[o][:-1])))  # one rank for one place
    late = np.zeros((len(doc), pad + 2), bool)
    rounds = []
    for c, order, lcp, before in column_wise(laid_out(at, lo, context, length)):
        rounds.append((c, before.tobytes(), lcp.tobytes()))
        if c > pad:
            continue
        start = at[order] - pad + c
        ok = (start >= lo[order]) & (start <= hi[order])
        run = np.flatnonzero(lcp < length)
        mine = np.where(ok, rank[order], len(doc))
        first = np.repeat(np.minimum.reduceat(mine, run), np.diff(np.append(run, len(order))))
        late[order[ok & (mine > first)], c] = True
    row, begin = np.nonzero(late[:, :-1] & ~np.pad(late, ((0, 0), (1, 0)))[:, :-2])
    _, end = np.nonzero(late[:, :-1] & ~late[:, 1:])
    base = at[row] - pad
    return (doc[row], base + begin, base + end), rounds


def contexts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """(h, doc_id, lo, hi, at, context bytes) of the wanted anchors (h, doc_id, lo, hi, at), cut from their texts."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("h", "lo", "hi", "at")).alias("want"))
    sliced = by_doc.join(docs, "doc_id").select("doc_id", F.explode("want").alias("w"), "text")
    return sliced.select("w.h", "doc_id", "w.lo", "w.hi", "w.at", F.expr(f"substring(text, w.lo + 1, w.hi - w.lo + {length})").alias("context"))


TRANSFORM = "doc_id long, lo int, hi int, first long, round int, symbols binary, lcp binary"


def compared(found: DataFrame, length: int, chunk: int = 30_000) -> DataFrame:
    """Ranges (doc_id, lo, hi) of repeated starts among contexts(), and between them the rounds (first, round, symbols, lcp) that show them.

    Contexts with one anchor hash are compared together, in chunks of about `chunk`; `first` is the first anchor hash of the
    chunk. Chunks and their rounds, last column first, come in sequence.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("first", pa.int64()), ("round", pa.int32()), ("symbols", pa.binary()), ("lcp", pa.binary())])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def out(parts):
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            h, doc, lo, hi, at = (whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            (d, a, b), rounds = repeats(doc, at, lo, hi, whole.column(5), length)
            ranges = [pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
            steps = [pa.array([int(h[0])] * len(rounds)), pa.array([c for c, _, _ in rounds], pa.int32()), pa.array([x for _, x, _ in rounds], pa.binary()), pa.array([x for _, _, x in rounds], pa.binary())]
            yield pa.RecordBatch.from_arrays(ranges + [pa.nulls(len(d), t) for t in kind.types[3:]], schema=kind)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rounds), t) for t in kind.types[:3]] + steps, schema=kind)

        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last hash of the batch may go on in the next one
            starts = not cut and held and held[-1].column(0)[-1].as_py() != h[0]
            if size + cut >= chunk and (cut or starts):
                yield from out([*held, b.slice(0, cut)] if cut else held)
                held, size = [], 0
            elif cut:
                held.append(b.slice(0, cut))
                size += cut
            held.append(b.slice(cut))
            size += b.num_rows - cut
        if held:
            yield from out(held)

    return found.repartition(partitions(found.sparkSession), "h").sortWithinPartitions("h").mapInArrow(run, TRANSFORM)


def kept(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) from (doc_id, text bytes, lo array, hi array of ranges of starts)."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            (los, his), lists = (b.column(i).flatten().to_numpy() for i in (2, 3)), b.column(2)
            size = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            for k, text in enumerate(b.column(1)):
                text = text.as_py()
                n, gone, n_spans, parts, at = len(text), 0, 0, [], 0
                lo, hi = los[size[k] : size[k + 1]], his[size[k] : size[k + 1]]
                fits = lo + length <= n
                lo, hi = lo[fits], np.minimum(hi[fits] + length, n)
                if len(lo):
                    o = np.argsort(lo, kind="stable")
                    lo, hi = lo[o], np.maximum.accumulate(hi[o])
                    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
                    for i, j in zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist()):
                        parts.append(text[at:i])
                        gone, n_spans, at = gone + j - i, n_spans + 1, j
                rest = b"".join([*parts, text[at:]])
                for c, v in zip(cols, (n, gone, n_spans, hashlib.sha256(rest).hexdigest(), rest)):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = 2_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) for every row: what is left without strings of `length` bytes that start earlier.

    Earlier means a smaller doc_id, or the same and a smaller start. Matches never cross rows, and strings are judged on the
    input. Null text is empty text; texts shorter than `length` lose nothing. Rows with a null doc_id neither lose bytes nor
    count as earlier. Rows that share a doc_id stand at the same places, so they don't repeat each other; what repeats in one is
    removed from all of them. Other columns are dropped; an empty table gives an empty table. A row holds a text with the ranges
    in it, about one for 34 bytes at most.

    Equal contexts are known by two 64-bit hashes; all others are compared byte by byte. The contexts of an anchor that seems
    to have over `hot` different ones are its single windows, so no task gets all contexts of a common anchor.
    """
    docs = as_bytes(texts(df, id_col, text_col))
    same = Window.partitionBy("h", "ctx").orderBy("doc_id", "lo")
    whole = Window.partitionBy("h")
    met = placed(docs, length, hot_anchors(docs, length, hot))
    ranked = met.repartition(partitions(df.sparkSession), "h").withColumn("leads", (F.row_number().over(same) == 1).cast("int")).withColumn("first", F.rank().over(same) == 1)
    ranked = ranked.filter("at < 0 or leads = 1 or not first")  # the leader's place in a repeated row is no repeat
    ranked = ranked.withColumn("leaders", F.sum("leads").over(whole)).filter("at < 0 or leads = 0 or leaders > 1")
    ranked = materialize(ranked.select("h", "doc_id", "lo", "hi", "at", F.expr("at < 0 or leads = 0").alias("sure")), "anchors")
    found = materialize(contexts(ranked.filter("not sure"), docs, length), "contexts")  # lets go of the shuffled texts
    transform = materialize(compared(found, length), "transform")
    discard(found)
    ranges = ranked.filter("sure").select("doc_id", "lo", "hi").union(transform.filter("round is null").select("doc_id", "lo", "hi"))
    per_doc = materialize(ranges.groupBy("doc_id").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")), "ranges")
    discard(ranked, transform)
    return kept(docs.join(per_doc, "doc_id", "left").select("doc_id", "text", "los", "his"), length)
