"""Quality classifier: multiple-instance learning with gated attention over the passages of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, binary_parts, spans, texts

PASSAGE = 400  # bytes, about; a passage ends after a word
CHUNK = 2 << 20
SAMPLE = 2_000  # labelled documents that the model is fitted on, at most
U64 = np.uint64
KINDS = 10


def _kinds() -> np.ndarray:
    """Class of every byte: lower, upper, digit, space, line end, full stop or comma, other mark, bar, non-ASCII lead, non-ASCII rest."""
    k = np.full(256, 6, np.uint8)
    for i, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".,")):
        k[list(chars)] = i
    k[ord("|")] = 7
    k[192:] = 8
    k[128:192] = 9
    return k


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, features) of texts data[offs[i]:offs[i+1]]; an empty text has one passage of zeros."""
    lo = int(offs[0])
    data, offs = data[lo : offs[-1]], offs - lo
    n_rows, n = len(offs) - 1, len(data)
    size = np.diff(offs)
    full = np.flatnonzero(size)
    if not len(full):
        return np.arange(n_rows), np.zeros((n_rows, FEATURES), np.float32)
    kind = _kinds()[data]
    gap = (kind == 3) | (kind == 4)
    wide = np.append(np.flatnonzero(gap), n)
    parts = np.maximum(1, size // PASSAGE)
    row = np.repeat(np.arange(n_rows), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offs[row] + nth * PASSAGE
    later = nth > 0
    begin[later] = np.minimum(wide[np.searchsorted(wide, begin[later])], offs[row[later] + 1])  # forward to the end of a word
    some = size[row] > 0
    keep = some & (begin < offs[row + 1])
    at, of = begin[keep], row[keep]
    uniq = np.append(True, at[1:] > at[:-1])
    at, of = at[uniq], of[uniq]
    count = np.stack([np.add.reduceat(kind == k, at, dtype=np.int32) for k in range(KINDS)], axis=1).astype(np.float64)
    total = count.sum(axis=1)
    # words: where they start, their length and a hash of their bytes
    edge = np.zeros(n, bool)
    edge[offs[:-1][full]] = True
    start = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | edge))
    part = np.searchsorted(at, start, side="right") - 1
    words = np.bincount(part, minlength=len(at)).astype(np.float64)
    stop = np.append(start[1:], n)
    spaces = np.append(0, np.cumsum(gap))
    length = stop - start - (spaces[stop] - spaces[start])
    byte = data.astype(np.uint64) + U64(1)
    sums = np.append(U64(0), np.cumsum(byte * byte * byte, dtype=np.uint64))
    after = np.append(U64(0), np.cumsum(byte[1:] * byte[:-1], dtype=np.uint64))  # takes in the order of the letters
    last = start + length
    mark = ((sums[last] - sums[start]) * U64(0x9E3779B97F4A7C15) ^ (after[last - 1] - after[start])) * U64(0xD6E8FEB86659FD93)
    again = np.zeros(len(at))
    if len(start) > 1:
        same = (mark[1:] == mark[:-1]) & (part[1:] == part[:-1])
        again += np.bincount(part[1:][same], minlength=len(at))
    key = (part.astype(np.uint64) << U64(40)) ^ (mark >> U64(24))
    distinct = np.bincount((np.unique(key) >> U64(40)).astype(np.int64), minlength=len(at))
    chars = np.maximum(1, total - count[:, 9])
    w = np.maximum(1, words)
    letters = np.maximum(1, count[:, 0] + count[:, 1] + count[:, 8])
    f = np.stack([
        count[:, 1] / letters, count[:, 2] / chars, count[:, 3] / chars, count[:, 4] / chars * 10, count[:, 5] / chars * 5, count[:, 6] / chars, count[:, 6] / w,
        count[:, 7] / w, count[:, 8] / chars, again / w, distinct / w, np.bincount(part, length, minlength=len(at)) / w / 10, np.log1p(words) / 5, np.bincount(part, length > 14, minlength=len(at)) / w, np.bincount(part, length < 3, minlength=len(at)) / w,
    ], axis=1).astype(np.float32)
    empty = np.flatnonzero(size == 0)
    if len(empty):
        of, f = np.append(of, empty), np.concatenate([f, np.zeros((len(empty), FEATURES), np.float32)])
        o = np.argsort(of, kind="stable")
        of, f = of[o], f[o]
    return of, f


FEATURES = 15


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """p(label | bag) = sigmoid(w . z + b) with z the sum of attention times encoded passages.

    A passage x, the ratios that passages() gives, is encoded as h = tanh(E x + e); its attention is the softmax over the bag of a . (tanh(V h) * sigmoid(U h)).
    """

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7, attention: bool = True):
        rng = np.random.default_rng(seed)
        shape = {"E": (FEATURES, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "w": (hidden,), "b": ()}
        self.p = {k: rng.normal(0, 0.3, s) if len(s) else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale, self.attention = np.zeros(FEATURES), np.ones(FEATURES), attention

    def forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray):
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        s = (v * u) @ p["a"] if self.attention else np.zeros(len(h))  # without attention all passages weigh alike
        s = np.exp(s - np.maximum.reduceat(s, first)[bag])
        att = s / np.add.reduceat(s, first)[bag]
        z = np.add.reduceat(att[:, None] * h, first, axis=0)
        return h, v, u, att, z, sigmoid(z @ p["w"] + p["b"])

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-3) -> Model:
        """Adam on the mean log loss of the bags; bag numbers ascend from 0 without gaps."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        m, v2 = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        xs, p = (x - self.mean) / self.scale, self.p
        for t in range(1, steps + 1):
            h, v, u, att, z, q = self.forward(x, first, bag)
            d = (q - y) / len(y)
            dz = d[:, None] * p["w"]
            dh = att[:, None] * dz[bag]
            da = (h * dz[bag]).sum(axis=1)
            ds = att * (da - np.add.reduceat(att * da, first)[bag])
            dvu = ds[:, None] * p["a"]
            gv, gu = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
            dh += gv @ p["V"].T + gu @ p["U"].T
            dx = dh * (1 - h * h)
            g = {"E": xs.T @ dx, "e": dx.sum(axis=0), "V": h.T @ gv, "U": h.T @ gu, "a": (v * u).T @ ds, "w": z.T @ d, "b": d.sum()}
            for k in p:
                grad = g[k] + decay * p[k] * (k != "b") / 10
                m[k] = 0.9 * m[k] + 0.1 * grad
                v2[k] = 0.999 * v2[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1])) if len(bag) else np.empty(0, np.int64)
        return self.forward(x, first, np.cumsum(np.append(0, bag[1:] != bag[:-1])))[-1] if len(bag) else np.empty(0)


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, features binary: a row of float32 for each passage) of (doc_id, text bytes, quality)."""

    def run(batches):
        for b in batches:
            raw, offs = binary_parts(b.column(1))
            out: list[bytes] = []
            for i, j in spans(offs, CHUNK):
                of, f = passages(raw, offs[i : j + 1])
                cut = np.searchsorted(of, np.arange(j - i + 1))
                out += [f[a:c].tobytes() for a, c in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["doc_id", "quality", "features"])

    return docs.mapInArrow(run, "doc_id long, quality int, features binary")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model fitted on at most `sample` labelled documents, those with the smallest hashed ids.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from. Labels other than 0 and 1 and null ids are passed
    over; of contradicting labels for one id the larger counts, of rows with one id one is taken. Without labelled rows, or
    with labels of one kind only, the score is the share of label 1, or 0.5.
    """
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = df.select(F.col(id_col).cast("long").alias("doc_id")).join(marks, "doc_id", "left_semi").distinct()
    chosen = ids.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = [(r.doc_id, r.quality) for r in chosen.collect()]  # `sample` rows at most
    model = Model()
    share = sum(q for _, q in rows) / len(rows) if rows else 0.5
    if share in (0, 1) or not rows:
        model.p["w"] = np.zeros_like(model.p["w"])
        model.p["b"] = np.array(np.log((share + 1e-3) / (1 - share + 1e-3)) if rows else 0.0)
        return model
    want = F.broadcast(df.sparkSession.createDataFrame(rows, "doc_id long, quality int"))  # `sample` rows at most
    got = bags(as_bytes(texts(df, id_col, text_col)).join(want, "doc_id").select("doc_id", "text", "quality")).collect()
    got = sorted({r.doc_id: r for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.features)))}.values(), key=lambda r: r.doc_id)
    x = [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in got]
    bag = np.repeat(np.arange(len(x)), [len(a) for a in x])
    return model.fit(np.concatenate(x).astype(np.float64), bag, np.array([r.quality for r in got], np.float64))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score) for every row, from its whole text; `keep` names columns to carry along instead of the id alone."""
    carried = [id_col] if keep is None else keep
    src = df.select(*carried, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    schema = df.select(*carried).schema.add("score", "double")

    def run(batches):
        for b in batches:
            raw, offs = binary_parts(b.column(b.num_columns - 1))
            got = [model.score(f.astype(np.float64), of) for i, j in spans(offs, CHUNK) for of, f in (passages(raw, offs[i : j + 1]),)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(got) if got else np.empty(0))], [*b.schema.names[:-1], "score"])

    return src.mapInArrow(run, schema)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; see train() for what is learned from.

    Null text is empty text and is scored like any other; a null id is never held out. Repeated rows come back repeated; other
    columns are dropped; an empty table gives an empty table.
    """
    model = train(df, labels, id_col, text_col, sample=sample)
    out = score(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
