import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from plyfold.llm import components, simhash, suffix

SCHEMA = "doc_id long, text string, fp string, h long, range int"


def rows(texts):
    return [(i, t, "clash", 1, 2) for i, t in texts]


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=4):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    base = [r.choice(words) for _ in range(120)]
    texts = [(0, None), (1, ""), (2, " \t"), (3, "One"), (4, "ONE"), (5, "a b c"), (6, "É x y z w")]
    for i in range(60):
        t = list(base)
        for _ in range(i % 6):
            t[r.randrange(120)] = r.choice(words)
        texts.append((10 + i, " ".join(t)))
    texts += [(100 + i, " ".join(r.choice(words) for _ in range(50))) for i in range(40)]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts}
    assert {i: x.fingerprint for i, x in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: x.component_id for i, x in got.items()} == plain_components(fps)


def test_simhash_tiles_and_edges(spark):
    rng = np.random.default_rng(2)
    fps = {int(i): int(x) for i, x in enumerate(rng.integers(0, 1 << 40, 300))}
    for i in range(100):
        fps[1000 + i] = fps[i] ^ (1 << i % 60) ^ (1 << (i * 7) % 60)
    fps = {i: f for f, i in {f: i for i, f in reversed(fps.items())}.items()}
    reps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "rep long, fp long")
    want = {i: c for i, c in plain_components(fps).items()}
    for tile in (20_000, 7):
        got = {i: i for i in fps} | {r.node: r.component for r in components.components(simhash.links(reps, 4, tile=tile, chunk=64)).collect()}
        assert got == want
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    same = spark.createDataFrame(rows([(7, "x y"), (7, "x y"), (None, "x y"), (None, "other words here now")]), SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(same).collect()) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def plain_prints(text, words=5):
    w = np.array([xxh64_intdigest(x, 7) for x in (text or "").encode().lower().split()], np.uint64)
    return simhash.three_prints(w, words)


def test_near_copies_against_all_pairs(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    texts = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "ONE  two"), (5, "one")]
    for b in range(12):
        base = make(r.randrange(8, 300))
        for k in range(8):
            t = list(base)
            for _ in range(k * len(t) // 100):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append((10 + 10 * b + k, " ".join(t)))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    prints = {i: plain_prints(t) for i, t in texts}
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            a, b = prints[i], prints[j]
            if (a[0] ^ b[0]).bit_count() <= 8 and (a[1] ^ b[1]).bit_count() + (a[2] ^ b[2]).bit_count() <= 25:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == root and len(set(got.values())) >= 14 and len({got[10 + k] for k in range(8)}) < 8


def test_near_copies_recall(spark):
    """Texts of 60 to 400 words, of which so many words are replaced that 0.8 or more of the five-word shingles stay, and others."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, near = [], []
    for b in range(700):
        base = [r.choice(words) for _ in range(r.randrange(60, 400))]
        t = list(base)
        for _ in range(r.randrange(1, 2 + len(t) // 40)):
            t[r.randrange(len(t))] = r.choice(words)
        a, c = shingles(base), shingles(t)
        texts += [(2 * b, " ".join(base)), (2 * b + 1, " ".join(t))]
        if len(a & c) / len(a | c) >= 0.8:
            near.append(2 * b)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert sum(got[i + 1] == i for i in near) >= 0.9 * len(near) > 300
    assert all(v in (k, k - 1) for k, v in got.items())


def test_near_copies_edges(spark):
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 100_000
    same = spark.createDataFrame(rows([(7, long), (9, long), (9, long), (None, long), (None, "other words here now"), (3, "")]), SCHEMA)
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_copies(same).collect()) == [(-1, -1), (-1, 7), (3, 3), (7, 7), (9, 7), (9, 7)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 7, 8, 15, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for i in range(1, 200, 3):
        flips = rng.integers(0, 64, rng.integers(0, 9))
        fp[i] = fp[i - 1] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else fp[i - 1]
    for d in (1, 2, 63, 64, 65, 130):
        valid = np.zeros(256, np.uint8)
        valid[: 200 - d] = 1
        got = simhash.within(simhash.planes(fp), d, np.packbits(valid, bitorder="little").view("<u8"), radius)
        assert sorted(got.tolist()) == np.flatnonzero(np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius).tolist()


def plain_removal(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(b[s : s + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for a, c in zip(b"\0" + bytes(gone), gone) if c and not a), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seen", [64, 12, 2])
def test_repeats_against_brute_force(spark, seen, monkeypatch):
    """Without hot anchors, with some, and with all of them hot."""
    monkeypatch.setattr(suffix, "SEEN", seen)
    r = random.Random(3)
    make = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared, long = make(300), make(2500)
    texts = [(0, None), (1, ""), (2, make(99)), (3, "a" * 400), (4, "ab" * 300), (5, long), (6, long), (7, long[:1200] + "X" + long[1201:])]
    texts += [(10 + i, make(r.randrange(200)) + shared[r.randrange(50) :][: 250 - i] + make(r.randrange(200))) for i in range(30)]
    texts += [(50, shared + make(10) + shared), (51, make(100)), (52, long[100:1100] + long[100:1100])]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.remove_repeats(spark.createDataFrame(rows(texts), SCHEMA), hot=2).collect()}
    assert got == plain_removal(texts, 100)


def test_repeats_edge_rows(spark):
    t = "some words " * 30
    got = suffix.remove_repeats(spark.createDataFrame(rows([(None, "z" * 300), (None, "z" * 300)]), SCHEMA)).collect()
    assert [x.n_removed for x in got] == [0, 0]
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = suffix.remove_repeats(spark.createDataFrame(rows([(5, t), (5, t)]), SCHEMA)).collect()
    assert len({(x.n_removed, x.kept_sha256) for x in twice}) == 1


@pytest.mark.parametrize("seen", [64, 2])
def test_repeated_rows_keep_a_copy(spark, seen, monkeypatch):
    """Against brute force on the rows once each: a repeated row stands where the first one does."""
    monkeypatch.setattr(suffix, "SEEN", seen)
    r = random.Random(10)
    make = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    shared, same = make(300), make(900)
    texts = [(5, same), (6, make(50) + shared + make(70)), (7, make(200) + shared + same[100:400]), (9, make(80) + shared[20:] + make(30) + shared[:180])]
    frame = spark.createDataFrame(rows(texts * 3), SCHEMA).repartition(3)
    got = [(x.doc_id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in suffix.remove_repeats(frame, hot=2).collect()]
    want = plain_removal(texts, 100)
    assert sorted(got) == sorted([*want.items()] * 3) and want[5][1] == 0 and want[7][1] > 500


def test_column_wise_construction():
    rng = np.random.default_rng(5)
    m = rng.integers(97, 100, (60, 40)).astype(np.uint8)
    m[30:] = m[:30]
    m[40:, :7] = 98
    for c, order, lcp, before in suffix.column_wise(m):
        tails = [m[i, c:].tobytes() for i in order]
        assert tails == sorted(tails)
        common = lambda a, b: next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        assert lcp.tolist() == [0, *(common(a, b) for a, b in zip(tails, tails[1:]))]
        assert before.tolist() == ([m[i, c - 1] for i in order] if c else [0] * 60)


def test_transform_gives_the_strings_back(spark):
    """The rounds in the table are the collection's transform: stable sorts by it lead from each round to the one before."""
    r = random.Random(12)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(100, 151))) for _ in range(50)]
    found = spark.createDataFrame([(i % 3, i, 0, len(t) - 100, 50, bytearray(t)) for i, t in enumerate(texts)], "h long, doc_id long, lo int, hi int, at int, context binary")
    for chunk in (1, 20, 1000):
        rounds = suffix.compared(found, 100, chunk=chunk).filter("round is not null").collect()
        back = []
        for first in {x.first for x in rounds}:
            mine = {x.round: np.frombuffer(x.symbols, np.uint8) for x in rounds if x.first == first}
            assert sorted(mine) == list(range(168))
            n = len(mine[0])
            out, place = np.zeros((n, 168), np.uint8), np.arange(n)  # row i of the final order, followed back to where it stood
            for c in range(167):
                by = np.argsort(mine[c + 1], kind="stable")
                out[:, c] = mine[c + 1][by][place]
                place = by[place]
            back += [x.tobytes()[:167] for x in out]
        want = [suffix.laid_out(np.array([50]), np.array([0]), pa.array([t]), 100)[0, :167].tobytes() for t in texts]
        assert sorted(back) == sorted(want)
