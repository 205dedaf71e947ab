"""SimHash fingerprints, near-duplicate links by bit-sliced comparison, and their components."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, discard, materialize, partitions, texts
from .components import components
from .decontaminate import Code, gram_hashes

BITS = 64
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text's UTF-8 bytes: A-Z lowered, words between ASCII white space, shingles hashed with XXH64; a bit is set if it is in over half of them."""
    from xxhash import xxh64_intdigest as xxh

    w = data.lower().split()
    if not w:
        return 0
    s = b" ".join(w)
    if len(w) <= words:
        hashes = [xxh(s, seed)]
    else:
        size = np.fromiter(map(len, w), np.int64, len(w))
        end = np.cumsum(size + 1) - 1
        hashes = [xxh(s[a:b], seed) for a, b in zip((end - size)[: len(w) - words + 1].tolist(), end[words - 1 :].tolist())]
    return bit_majority(np.array(hashes, dtype=np.uint64))


def bit_majority(h: np.ndarray) -> int:
    """The number whose bits are those set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 255):  # sums of at most 255 fit in a byte
        total += np.add.reduce(np.unpackbits(h[i : i + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def three_prints(w: np.ndarray, words: int = 5) -> tuple[int, int, int]:
    """SimHash of the different two-word shingles, and two by independent hashes of the shingles of `words` words, from word hashes."""
    if not len(w):
        return 0, 0, 0
    long = gram_hashes(w, min(words, len(w)))
    other = (long ^ (long >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return bit_majority(np.unique(gram_hashes(w, min(2, len(w))))), bit_majority(long), bit_majority(other ^ (other >> np.uint64(32)))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) for every row of (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return as_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, same: int) -> list[int]:
    """Bit masks of every choice of `same` of `blocks` near-equal blocks."""
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), same)]


def plan(n: int, radius: int) -> list[int]:
    """The cheapest exact set of masks for n fingerprints: of b blocks at most `radius` hold a difference, so b - radius agree."""

    def cost(b: int) -> float:  # of a row, and of its pairs in a bucket: 64 of these are compared at once, so each is far cheaper
        return comb(b, radius) * n * (1 + 0.002 * n / 2 ** (BITS * (b - radius) / b))

    b = min(range(radius + 1, radius + 7), key=cost)
    return masks(b, b - radius)


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit j of every fingerprint, 64 fingerprints to a word."""
    n = -(-len(fp) // 64) * 64
    bits = np.zeros((n, BITS), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three planes: the ones and the twos of every column."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(p: np.ndarray, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Places i (of those set in `valid`) where fingerprints i and i + d differ in at most `radius` bits.

    Differences are added eight planes at a time by carry-save adders, and their sum to counters of as many bits as the radius
    needs, with one more bit that stays set on overflow; after that, words in which every distance is over the radius are given up.
    """
    live = np.flatnonzero(valid)
    top = (radius + 1).bit_length()
    count = [np.zeros(len(live), np.uint64) for _ in range(top)]
    over, w, b = ~valid[live], *divmod(d, 64)
    right, left = np.uint64(b), np.uint64(64 - b) if b else None
    if p.shape[1] < len(valid) + w + 1:
        p = np.pad(p, ((0, 0), (0, w + 1)))  # what lies beyond the last fingerprint is not valid

    def beyond() -> np.ndarray:
        """Bits whose count is over the radius: compared from the highest counter bit on."""
        more, same = np.zeros(len(live), np.uint64), np.full(len(live), ALL)
        for k in range(top - 1, -1, -1):
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        return more

    for j in range(0, BITS, 8):
        part, lo = p[j : j + 8], live + w
        x = part.take(lo, axis=1)
        if b:
            x >>= right
            x |= part.take(lo + 1, axis=1) << left
        x ^= part.take(live, axis=1)
        one, two = added(x[0], x[1], x[2])
        one_b, two_b = added(x[3], x[4], x[5])
        one, two_c = added(one, one_b, x[6])
        one, two_d = one ^ x[7], one & x[7]
        two, four = added(two, two_b, two_c)
        two, four_b = two ^ two_d, two & two_d
        carry = np.zeros(len(live), np.uint64)
        for k, bits in enumerate((one, two, four ^ four_b, four & four_b)):
            if k < top:
                count[k], carry = added(count[k], bits, carry)
            else:
                over |= bits
        for k in range(4, top):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        over |= beyond()
        keep = over != ALL
        if not keep.any():
            return np.empty(0, np.int64)
        if j + 8 < BITS and keep.mean() < 0.7:
            live, over, count = live[keep], over[keep], [c[keep] for c in count]
    word, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return live[word] * 64 + bit


def local_links(group: np.ndarray, fp: np.ndarray, radius: int, more: list[np.ndarray] | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group: (row, root row) for every row linked in its group, one edge per row however many pairs there are.

    With `more` fingerprints a pair links only if these differ in at most `most` bits together as well.
    """
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root[:0], root[:0]
    end = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
    left = np.repeat(end, np.diff(np.append(0, end))) - np.arange(n)  # rows of the group from this one on
    p, d = planes(fp), 1
    size = p.shape[1] * 64
    p = np.pad(p, ((0, 0), (0, p.shape[1] + 1)))
    while True:
        ok = left > d
        if not ok.any():
            break
        bits = np.zeros(size, np.uint8)
        bits[:n] = ok
        i = within(p, d, np.packbits(bits, bitorder="little").view("<u8"), radius)
        if more:
            i = i[sum(np.bitwise_count(m[i] ^ m[i + d]).astype(np.int64) for m in more) <= most]
        i, j = root[i], root[i + d]
        while len(i := i[(far := i != j)]):
            j = j[far]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root = root[root]
            i, j = root[i], root[j]
        d += 1
    row = np.flatnonzero(root != np.arange(n))
    return row, root[row]


def links(reps: DataFrame, radius: int = 4, tile: int = 20_000, chunk: int = 65_536, most: int = 0) -> DataFrame:
    """(u, v) edges that connect exactly what links within `radius` connect, from (rep long, fp long) with distinct rows.

    Columns after fp are further fingerprints; a pair also has to agree in all but `most` of their bits.

    Each mask of plan() deals the fingerprints into buckets; pairs within the radius share at least one. Only edges from a row
    to its root inside the bucket leave a task. A bucket of over `tile` rows is cut into tiles, and each two tiles meet in a
    bucket of their own, so no bucket is skipped and none holds over about 2 * tile rows.
    """
    spark, more = reps.sparkSession, [c for c in reps.columns if c not in ("rep", "fp")]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))).alias("key")) for t, m in enumerate(plan(reps.count(), radius))])
    dealt = reps.select("rep", "fp", *more, F.explode(keys).alias("k")).select("rep", "fp", *more, "k.t", "k.key")
    big = dealt.groupBy("t", "key").count().filter(F.col("count") > tile).select("t", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    big = materialize(big, "big-buckets")
    if big.isEmpty():
        dealt = dealt.withColumn("pair", F.lit(0))
    else:
        dealt = dealt.join(big, ["t", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1))
        dealt = dealt.withColumn("other", other).withColumn("pair", F.least("mine", "other") * 65_536 + F.greatest("mine", "other"))
    dealt = dealt.select(F.xxhash64("t", "key", "pair").alias("bucket"), "rep", "fp", *more)
    dealt = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "fp")

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts, final):
            bucket, rep, *fps = (np.concatenate(x) for x in zip(*parts))
            cut = len(bucket) if final else int(np.searchsorted(bucket, bucket[-1]))
            fp, *others = (x[:cut].view(np.uint64) for x in fps)
            row, root = local_links(bucket[:cut], fp, radius, others, most)
            return pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.array(rep[root])], ["u", "v"]), [(bucket[cut:], rep[cut:], *(x[cut:] for x in fps))]

        for b in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            if sum(len(x[0]) for x in held) >= chunk:
                edges, held = out(held, False)
                yield edges
        if held:
            yield out(held, True)[0]

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: equal or near fingerprints share a component, named by its smallest doc_id.

    Null text is empty text; texts without words have fingerprint zero and link like any other. Repeated rows come back
    repeated. A row without doc_id links nothing; its component is that of its fingerprint, or null if no row with that
    fingerprint has an id. Other columns are dropped. An empty table gives an empty table.
    """
    fps = materialize(fingerprints(texts(df, id_col, text_col), words), "fingerprints")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    joined = components(links(reps.filter("rep is not null"), radius))
    named = materialize(reps.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "fingerprint-components")
    discard(reps)
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def copy_groups(df: DataFrame, keys: list[str], text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 8) -> DataFrame:
    """(keys, __group long) for every row of df: texts whose SimHashes of `words`-word shingles agree in `similarity` of 128 bits share a group.

    128 bits can't be searched at the distance that edited copies have. So a pair must also be within `radius` on 64 bits of
    two-word shingles, which an edit changes less; that search is exact, and texts that differ in both are told apart by 192 bits
    in all. Words are those of fingerprint(). Null text is empty text; texts without words are equal. Repeated rows come back
    repeated, an empty table gives an empty table, null keys stay. Each mask of plan() copies the fingerprints of a text once: 9 copies
    up to some 280,000 different texts, 45 up to ten million, more beyond.
    """
    bounded_batches(df.sparkSession)
    kind = df.select(*keys).schema
    for name in ("__fp", "__b", "__c"):
        kind = kind.add(name, "long")

    def run(batches):
        code = Code()
        for batch in batches:
            fps = np.array([three_prints(code(t.lower().split()), words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x) for x in fps.T.copy())], kind.names)

    src = df.select(*keys, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    fps = materialize(src.mapInArrow(run, kind), "fingerprints")
    reps = fps.select(F.col("__fp").alias("fp"), F.col("__b").alias("b"), F.col("__c").alias("c")).distinct()
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "distinct-fingerprints")
    joined = components(links(reps.select("rep", "fp", "b", "c"), radius, most=int((1 - similarity) * 2 * BITS)))
    named = reps.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.col("b").alias("__b"), F.col("c").alias("__c"), F.coalesce("component", "rep").alias("__group"))
    return fps.join(named, ["__fp", "__b", "__c"]).select(*keys, "__group")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 8) -> DataFrame:
    """(doc_id, component_id) for every row: the groups of copy_groups(), named by their smallest doc_id; null if no row of one has an id.

    Other columns are dropped.
    """
    groups = materialize(copy_groups(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text", words, similarity, radius), "copy-groups")
    names = groups.groupBy("__group").agg(F.min("doc_id").alias("component_id"))
    return groups.join(names, "__group").select("doc_id", "component_id")
