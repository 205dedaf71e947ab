"""Token ids as Re-Pair grammars: tokenise, write shards in doc_id order, read them back whole or at any place."""

from __future__ import annotations

import re
import struct
import sys
import types
import zlib
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, texts

MAGIC = b"RPG1"
SLOT_BITS = 18  # 2 ** SLOT_BITS counters of neighbouring pairs at most
BLOCK = 1024  # symbols between stored places of a shard's stream
RANGES = 65_536  # most ranges of doc_id; their first places are what goes to every task


class Letters(dict):
    """The byte-level alphabet's text of a character."""

    def __init__(self, hidden: dict[int, int]):
        super().__init__()
        self.hidden = hidden

    def __missing__(self, c: str) -> str:
        shown = self[c] = c.encode().decode("latin-1").translate(self.hidden)
        return shown


class Encoder(dict):
    """Bytes of the ids (16 bits each, little-endian) of a piece of text, remembered.

    The vocabulary's pattern never joins a word to the white space after it. So a text without two white-space characters in a
    row, and none but space and line feed, is cut before each of these, and each piece is encoded once. Other texts go to the
    tokenizer whole: such a piece is never remembered, so it is met as a missing one, and raises Odd. ASCII marks that end a piece
    after a letter are a piece of their own; an apostrophe is not, as the pattern may join it to letters.
    """

    class Odd(Exception):
        pass

    space = re.compile(r"\s")
    marks = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    most = 600_000  # pieces, about 100 bytes each

    def __init__(self, vocabulary: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids of over 16 bits")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level alphabet: these bytes are themselves, others follow from 256
        hidden = [b for b in range(256) if b not in shown]
        self.letters = Letters({b: 256 + i for i, b in enumerate(hidden)})
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line, self.gap = self.whole("\n"), self.letters[" "]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def word(self, text: str) -> bytes:
        """Ids of letters, perhaps after a space, which the pattern keeps together: straight from the vocabulary's merges."""
        return array("H", [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, text)))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            ids = self[piece] = array("H", [t.id for t in self.model.tokenize(self.gap + piece)]).tobytes() if piece.isascii() else self.word(" " + piece)
            return ids
        lead = piece[:1]
        if piece in ("", "\n") or self.space.search(piece, lead == "\n"):
            raise self.Odd
        head = piece.rstrip(self.marks)
        if len(head) < len(piece) and head[-1:].isalpha() and not any(x in piece for x in self.added):
            ids = self[head] + self["\0" + piece[len(head) :]]
        elif lead in "\n\0" and piece[1:].isalpha():
            ids = (self.line if lead == "\n" else b"") + self.word(piece[1:])
        else:
            ids = self.whole(piece[1:] if lead == "\0" else piece if lead == "\n" else " " + piece)
        self[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if "\0" in text:  # the mark of a first piece
            return self.whole(text)
        if len(self) > self.most:
            self.clear()
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if rest and rest[-1] in ("", "\n"):  # a text that ends with one white space
                return self["\0" + first] + b"".join(map(self.__getitem__, rest[:-1])) + self.whole(rest[-1] or " ")
            return self["\0" + first] + b"".join(map(self.__getitem__, rest))
        except self.Odd:
            return self.whole(text)


def encoder(vocabulary: str) -> Encoder:
    """One Encoder per process and vocabulary (the text of its file)."""
    held = sys.modules.setdefault("_plyfold_encoders", types.ModuleType("_plyfold_encoders")).__dict__
    key = f"{zlib.crc32(vocabulary.encode()):08x}-{len(vocabulary)}"
    if key not in held:
        held[key] = Encoder(vocabulary)
    return held[key]


def grammar(ids: np.ndarray, base: int, per_round: int = 8192, least: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(stream, rules): ids with frequent pairs replaced by nonterminals base, base + 1, ...; rules[i] is the pair that base + i stands for.

    A round makes rules of frequent pairs and replaces all of these from the left, so that a later round pairs nonterminals too.
    At first pairs are counted by hash, and the `per_round` most frequent are taken. When hashes show no more, pairs are counted
    one by one and all that occur `least` times are taken; after that only pairs with a symbol of the last round can be new among
    the frequent, so only these are counted. Rounds go on until no pair occurs `least` times, or all symbols under 2 ** 16 are taken.
    """
    x, rules = ids.astype(np.uint32), []
    exact, fresh = False, 0

    def best(count: np.ndarray, room: int) -> np.ndarray:
        """Places of the up to `room` largest counts of at least `least`."""
        some = np.flatnonzero(count >= least)
        return some if len(some) <= room else some[np.argpartition(count[some], -room)[-room:]]

    while len(x) > 1 and (room := 65_536 - base - len(rules)) > 0:
        if not fresh:
            bits = min(SLOT_BITS, max(8, len(x).bit_length() - 3))
            key = x[:-1] << np.uint32(16) | x[1:]
            slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            count = np.bincount(slot, minlength=1 << bits)
            hot = np.zeros(1 << bits, bool)
            hot[best(count, 1 << bits if exact else min(room, per_round))] = True
            at = np.flatnonzero(hot[slot])
            few = key[at]
        else:
            at = np.flatnonzero((x[:-1] >= fresh) | (x[1:] >= fresh))
            few = x[at] << np.uint32(16) | x[at + 1]
        if exact:
            found, place, count = np.unique(few, return_inverse=True, return_counts=True)
            top = best(count, room)
            if not len(top):
                break
            rule = np.full(len(found), -1, np.int32)
            rule[top] = np.arange(len(top))
            made, k, fresh = found[top], rule[place], base + len(rules)
        else:
            slot = slot[at]
            pair = np.zeros(1 << bits, np.uint32)
            pair[slot] = few  # a pair of every frequent hash; most often the most frequent
            hit = pair[slot] == few
            top = best(np.bincount(slot[hit], minlength=1 << bits), min(room, per_round))
            if not len(top):
                exact = True
                continue
            rule = np.full(1 << bits, -1, np.int32)
            rule[top] = np.arange(len(top))
            made, k = pair[top], np.where(hit, rule[slot], -1)
        at, k = at[k >= 0], k[k >= 0]
        begins = np.append(True, at[1:] != at[:-1] + 1)
        place = np.arange(len(at))
        keep = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at, k = at[keep], k[keep]
        exact |= len(at) < len(x) // 64
        x[at] = (base + len(rules) + k).astype(np.uint32)
        rules += [(p >> 16, p & 0xFFFF) for p in made.tolist()]
        stay = np.ones(len(x), bool)
        stay[at + 1] = False
        x = x[stay]
    return x.astype(np.uint16), np.array(rules, np.uint16).reshape(-1, 2)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        size[base + i] = size[a] + size[b]
    return size


def write_shard(doc_ids: np.ndarray, known: np.ndarray, n_ids: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """The shard file: header, doc ids, ids per document, rules, rule lengths, places of stream blocks, stream."""
    stream, rules = grammar(ids, base)
    size = rule_lengths(rules, base)
    places = np.append(0, np.cumsum(size[stream]))[::BLOCK]
    head = struct.pack("<4sIQQQQ", MAGIC, base, len(doc_ids), len(rules), len(stream), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), n_ids.astype("<u8").tobytes(), rules.astype("<u2").tobytes(), size[base:].astype("<u4").tobytes(), places.astype("<u8").tobytes(), stream.astype("<u2").tobytes()])


class Shard:
    """A shard file read back."""

    def __init__(self, data: bytes):
        magic, self.base, docs, rules, stream, self.n_ids = struct.unpack_from("<4sIQQQQ", data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.doc_sizes = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.rules, lengths = take("<u2", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.places = take("<u8", -(-(stream + 1) // BLOCK)).astype(np.int64)
        self.stream = take("<u2", stream)
        self.size = np.append(np.ones(self.base, np.int64), lengths.astype(np.int64))
        self.doc_starts = np.append(0, np.cumsum(self.doc_sizes))
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first places): what every symbol stands for, one after the other."""
        if self._table is None:
            first = np.append(0, np.cumsum(self.size))
            flat = np.empty(first[-1], np.uint16)
            flat[: self.base] = np.arange(self.base)
            for i, (a, b) in enumerate(self.rules.tolist()):
                at, mid = first[self.base + i], first[self.base + i] + self.size[a]
                flat[at:mid] = flat[first[a] : first[a + 1]]
                flat[mid : first[self.base + i + 1]] = flat[first[b] : first[b + 1]]
            self._table = flat, first
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, first = self.expansions()
        size = self.size[symbols]
        step = np.ones(int(size.sum()), np.int64)
        ends = np.cumsum(size)
        if len(symbols):
            step[0] = first[symbols[0]]
            step[ends[:-1]] = first[symbols[1:]] - first[symbols[:-1]] - size[:-1] + 1
        return flat[np.cumsum(step)]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from place start to stop; only the blocks that hold them are expanded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint16)
        a = int(np.searchsorted(self.places, start, side="right")) - 1
        b = int(np.searchsorted(self.places, stop, side="left"))
        part = self.expand(self.stream[a * BLOCK : b * BLOCK])
        return part[start - self.places[a] : stop - self.places[a]]


def encoded(docs: DataFrame, vocabulary: Broadcast, bounds: list[int], end_id: int) -> DataFrame:
    """(range, doc_id, ids binary) of (doc_id, text); `bounds` are the first doc ids of every range but the first."""

    def run(batches):
        code, edge, end = encoder(vocabulary.value), np.array(bounds, np.int64), struct.pack("<H", end_id)
        for b in batches:
            ids = pa.array([code(t) + end for t in b.column(1).to_pylist()], pa.binary())
            key = b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edge, key, side="right").astype(np.int32)), b.column(0), ids], ["range", "doc_id", "ids"])

    return docs.mapInArrow(run, "range int, doc_id long, ids binary")


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = 4_000_000) -> DataFrame:
    """(range, shard, before, n_ids, data binary), a row for each shard file: the ids of all texts in ascending doc_id order.

    Each text's ids end with `end_id`; a null text is empty. Null ids come first; of rows with one doc_id the one with smaller
    ids comes first. `before` counts the ids of the range in earlier shards. A shard closes after the document that brings it
    to `shard_ids` ids. An empty table gives no shard; other columns are dropped. The vocabulary file at `path` is read by the
    driver, which sends its text (a few MB) to the executors.
    """
    docs = texts(df, id_col, text_col)
    vocabulary = df.sparkSession.sparkContext.broadcast(Path(path).read_text())
    base = Encoder(vocabulary.value).tokenizer.get_vocab_size()
    n = min(RANGES, 4 * partitions(df.sparkSession))
    bounds = sorted({int(x) for x in docs.filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    rows = encoded(docs, vocabulary, bounds, end_id).repartition(partitions(df.sparkSession), "range").sortWithinPartitions("range", "doc_id", "ids")

    def run(batches):
        held: list[tuple] = []
        size = before = shard = 0
        now = None

        def close():
            nonlocal held, size, before, shard
            keys = [k for k, _ in held]
            ids = np.frombuffer(b"".join(x for _, x in held), "<u2")
            blob = write_shard(np.array([k or 0 for k in keys], np.int64), np.array([k is not None for k in keys]), np.array([len(x) // 2 for _, x in held]), ids, base)
            out = [pa.array([v], t) for v, t in zip((now, shard, before, len(ids), blob), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
            held, before, size, shard = [], before + len(ids), 0, shard + 1
            return pa.RecordBatch.from_arrays(out, ["range", "shard", "before", "n_ids", "data"])

        for b in batches:
            for r, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and (r != now or size >= shard_ids):
                    yield close()
                if r != now:
                    now, before, shard = r, 0, 0
                held.append((key, ids))
                size += len(ids) // 2
        if held:
            yield close()

    return rows.mapInArrow(run, "range int, shard int, before long, n_ids long, data binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shard files. start counts all ids before it, over all files."""
    sizes = sorted((r["range"], r["n"]) for r in shards.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())  # RANGES rows at most
    first, total = {}, 0
    for r, n in sizes:
        first[r], total = total, total + n

    def run(batches):
        for b in batches:
            for r, before, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = Shard(data)
                ids, starts = s.ids().astype("<u4"), s.doc_starts
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64(), mask=s.known == 0), pa.array(starts[:-1] + before + first[r]), pa.array(s.doc_sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("range", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, path: str, **options) -> DataFrame:
    """write_shards() to the shared folder, then read_shards() from there."""
    return read_shards(materialize(write_shards(df, path, **options), "shards"))
