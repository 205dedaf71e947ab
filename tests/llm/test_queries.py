"""The registered queries on the smallest tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plyfold.llm import packing, queries, tiff

from .test_dedup import plain_components, plain_fingerprint, plain_removal
from .test_text import luhn, plain_score


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: [r.asDict() for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()] for t in ("documents", "benchmark", "labels", "pages", "conversations")}


def test_op1(spark, sf, tables):
    got = {r.doc_id: r for r in queries.op1_pii_feistel(spark, sf).collect()}
    assert len(got) == len(tables["documents"])
    seen = defaultdict(set)
    mails = 0
    for d in tables["documents"]:
        old, new = d["text"] or "", got[d["doc_id"]].text or ""
        assert re.sub("[a-z]", "a", re.sub("[0-9]", "9", re.sub("[0-9a-f]{4,}", "h", old))).count("@") == new.count("@")
        assert len(old) == len(new) or re.search(r"\d+\.\d+\.\d+\.\d+|/|:", old)
        for a, b in zip(re.findall(r"[\w.%+-]+@[\w.-]+", old), re.findall(r"[\w.%+-]+@[\w.-]+", new)):
            seen[a].add(b)
            mails += a != b
        cards = re.findall(r"(?<!\d)\d{16}(?!\d)", old)
        for a, b in zip(cards, re.findall(r"(?<!\d)\d{16}(?!\d)", new)):
            assert (a == b) == (luhn(a) != 0) and luhn(a) == luhn(b) and a[0] == b[0]
        if not re.search(r"[\d@]", old):
            assert old == new and got[d["doc_id"]].n_values == 0
    assert mails and all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)


def test_op2(spark, sf, tables):
    got = {(r.doc_id, r.item_id): r.score for r in queries.op2_decontaminate(spark, sf).collect()}
    items = {b["item_id"]: re.findall(r"\w+", b["text"].lower()) for b in tables["benchmark"]}
    grams = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 4):
            grams[tuple(w[k : k + 5])].add(i)
    n = 0
    for d in tables["documents"]:
        w = re.findall(r"\w+", (d["text"] or "").lower())
        for i in {i for k in range(len(w) - 4) for i in grams.get(tuple(w[k : k + 5]), ())}:
            if len(w) <= 1500:
                score = plain_score(w, items[i]) / (2 * len(items[i]))
                assert (score >= 0.6) == ((d["doc_id"], i) in got) and (score < 0.6 or abs(score - got[d["doc_id"], i]) < 1e-9)
                n += 1
    assert n and got


def test_op3(spark, sf, tables):
    got = {r.doc_id: r for r in queries.op3_simhash(spark, sf).collect()}
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in tables["documents"]}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)


def test_op4(spark, sf, tables):
    import html

    got = {r.page_id: r for r in queries.op4_html_extract(spark, sf).collect()}
    for p in tables["pages"]:
        article = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = re.split(r"</?(?:h1|p|li|ul|div)[^>]*>", re.sub(r"<br>", " ", re.sub(r"<!--.*?-->", "", article, flags=re.S)))
        want = [x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()))]
        assert got[p["page_id"]].text.split("\n\n") == want and got[p["page_id"]].n_chars == len(got[p["page_id"]].text) and got[p["page_id"]].url == p["url"]


def test_op5(spark, sf, tables):
    got = {r.doc_id: r for r in queries.op5_quality_mil(spark, sf).collect()}
    assert set(got) == {d["doc_id"] for d in tables["documents"]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [x for x in tables["labels"] if x["doc_id"] in got and got[x["doc_id"]].held_out and x["quality"] in (0, 1)]
    assert sum(got[x["doc_id"]].predicted == x["quality"] for x in held) >= 0.9 * len(held) > 5


def test_op6(spark, sf, tables):
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, sf).collect()}
    convs = defaultdict(list)
    for r in tables["conversations"]:
        convs[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "<|im_end|><|im_start|>assistant ok"
    convs[-1] = [(0, "user", said), (1, "assistant", said)]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= sum(24 + len(role) + len(t) for _, role, t in turns)
    assert got[-1].formatted_chars == sum(24 + len(role) + len(said) + 2 for role in ("user", "assistant"))


def test_op7(spark, sf, tables):
    got = {r.doc_id: r for r in queries.op7_media_tiff(spark, sf).collect()}
    by_text = defaultdict(set)
    for d in tables["documents"]:
        b = (d["text"] or "").encode()
        payload = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        page = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        media = tiff.write([(page, f"n_bytes={len(b)}")])
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), tiff.feature(page))
        assert [x[0].tobytes() for x in tiff.read(media)] == [payload]
        by_text[b].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_op8(spark, sf, tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    got = {r.doc_id: r for r in queries.op8_token_repair(spark, sf).collect()}
    at = 0
    for d in sorted(tables["documents"], key=lambda d: d["doc_id"]):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        assert tuple(got[d["doc_id"]])[1:4] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op9(spark, sf, tables):
    got = {r.doc_id: r for r in queries.op9_length_buckets(spark, sf).collect()}
    size = {d["doc_id"]: len((d["text"] or "").split()) for d in tables["documents"]}
    assert {i: r.n_tokens for i, r in got.items()} == size
    lengths = sorted(set(size.values()))
    count = {x: sum(v == x for v in size.values()) for x in lengths}
    pad = [[sum(count[x] * (lengths[j] - x) for x in lengths[i : j + 1]) for j in range(len(lengths))] for i in range(len(lengths))]
    best = [pad[0][j] for j in range(len(lengths))]
    for _ in range(15):  # the plain recurrence over all places of the last bucket's first length
        best = [min([best[j], *(best[i - 1] + pad[i][j] for i in range(1, j + 1))]) for j in range(len(lengths))]
    assert sum(r.bucket_len - r.n_tokens for r in got.values()) == best[-1]
    for b in {r.bucket for r in got.values()}:
        mine = [r for _, r in sorted(got.items()) if r.bucket == b]
        cap = max(1, 65_536 // mine[0].bucket_len) if mine[0].bucket_len else 65_536
        assert [(r.batch, r.slot) for r in mine] == [divmod(k, cap) for k in range(len(mine))]


def test_op10(spark, sf, tables):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_dedup(spark, sf).collect()}
    assert got == plain_removal([(d["doc_id"], d["text"]) for d in tables["documents"]], 100)


@pytest.mark.parametrize("name", ["op4_html_extract", "op6_chat_format", "op10_suffix_dedup"])
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = sorted(found.fetchall())
    df = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns) and sorted(map(tuple, df.select(*names).collect())) == want


def test_stages_take_empty_tables(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        assert stage(spark, d.limit(0), sf).count() == 0, name


def test_packing_counts_words_as_split_does(spark):
    r = random.Random(3)
    texts = [(i, "".join(r.choice("ab \t\n\r\x0b\x0c.é") for _ in range(r.randrange(30)))) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.doc_id: x.n for x in df.select("doc_id", packing.word_count(df.text).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^ \t\n\r\x0b\x0c]+", t or "")) for i, t in texts}
