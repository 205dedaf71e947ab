import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyfold.llm import chat, decontaminate, extract, packing, pii, quality, queries, repair, tiff

DOCS = "doc_id long, text string, score double, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in texts], DOCS)


# PII
def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def test_pii_formats_and_links(spark):
    text = "Mail jo.doe42@mail8.example.com, call +1 (743) 555-3824 or +1 (126) 555-3824 or +49 30 1234567, card 4111 1111 1111 1111 or 4539578763621486###, order 4785380592391130, host 152.143.123.131 v1.2.3, ssn 123-45-6789, born 1980-02-29 or 29/02/1980, bad 1980-02-30."
    got = pii.pseudonymize(docs(spark, [(1, text), (2, text[::1]), (3, None), (4, ""), (5, "clean words 7"), (6, "x 10.0.0.1")]), "k").orderBy("doc_id").collect()
    a, b = got[0].text, got[1].text
    assert a == b and got[2].text is None and got[3].text == "" and got[4].text == "clean words 7" and got[0].n_values == 10
    assert re.sub(r"\d", "9", re.sub("[a-z]", "a", a.split(",")[0])) == re.sub(r"\d", "9", re.sub("[a-z]", "a", text.split(",")[0]))
    for old in ("jo.doe42", "743) 555-3824", "126) 555", "1234567", "4111 1111 1111 1111", "4539578763621486", "152.143.123.131", "123-45-6789", "1980-02-29", "29/02/1980"):
        assert old not in a
    assert "bad 1980-02-30" in a and "4785380592391130" in a and "v1.2.3" in a and "@mail8.example.com" in a and "+49 30" not in a or "+49" in a
    cards = re.findall(r"4\d{3} \d{4} \d{4} \d{4}|4\d{15}", a)
    assert [luhn(c.replace(" ", "")) for c in cards] == [0, 0, luhn("4785380592391130")] and luhn("4785380592391130")
    assert pii.pseudonymize(docs(spark, [(1, text)]), "other").first().text != a
    assert pii.pseudonymize(docs(spark, []), "k").count() == 0


def iban_rest(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_pii_other_formats(spark):
    import datetime as dt

    found = {
        "3/4/1980": r"\d{1,2}/\d{1,2}/[12]\d{3}", "12/25/1980": r"\d\d/\d\d/[12]\d{3}", "4/25/1980": r"\d{1,2}/\d{1,2}/[12]\d{3}", "04.03.1980": r"\d\d\.\d\d\.[12]\d{3}", "1980/03/04": r"[12]\d{3}/\d\d/\d\d",
        "March 3, 1980": r"[A-Z][a-z]+ \d{1,2}, [12]\d{3}", "3 March 1980": r"\d{1,2} [A-Z][a-z]+ [12]\d{3}", "Mar 3, 1980": r"[A-Z][a-z]{2} \d{1,2}, [12]\d{3}", "DE89 3704 0044 0532 0130 00": r"DE\d\d( \d{4}){4} \d\d", "GB82WEST12345698765432": r"GB\d\d[A-Z]{4}\d{14}",
        "2001:db8:0:0:1:2:3:4": r"[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f](:[0-9a-f]){5}", "fe80::1ff:fe23:4567:890a": r"[0-9a-f]{4}::[0-9a-f]{3}(:[0-9a-f]{4}){3}", "2001:DB8::8A2E:370": r"[0-9A-F]{4}:[0-9A-F]{3}::[0-9A-F]{4}:[0-9A-F]{3}", "010-1234-5678": r"0\d\d-\d{4}-\d{4}",
    }
    stay = ["DE89 3704 0044 0532 0130 01", "41/13/1980", "30/30/1980", "std::cout", "12:30:45", "1234567890123456", "version 10.11.12", "V1.2.1999.4", "face::dead", "ab12cd34"]
    rows = [(i, f"on {t}.") for i, t in enumerate([*found, *stay])]
    got = {r.doc_id: r.text[3:-1] for r in pii.pseudonymize(docs(spark, rows + [(900, "on 1980-03-03."), (901, "on 03.03.1980."), (902, "on 3/3/1980.")]), "k").collect()}
    for i, (t, form) in enumerate(found.items()):
        assert got[i] != t and re.fullmatch(form, got[i]), (t, got[i])
    assert [got[len(found) + i] for i in range(len(stay))] == stay
    assert iban_rest(got[8]) == iban_rest(got[9]) == 1
    day = dt.date.fromisoformat(got[900])  # one date in all its forms stays one date
    assert got[901] == day.strftime("%d.%m.%Y") and got[902] == f"{day.day}/{day.month}/{day.year}" and got[5] == f"{day:%B} {day.day}, {day.year}" and got[6] == f"{day.day} {day:%B} {day.year}" and got[7] == f"{day:%b} {day.day}, {day.year}"


def test_pii_long_texts_and_clashing_columns(spark):
    text = "call +1 (743) 555-3824 now " * 20_000
    df = spark.createDataFrame([(1, text, "a", 3), (1, text, "a", 3), (2, None, None, None)], "doc_id long, text string, __values string, n_values long")
    got = pii.pseudonymize(df, "k").collect()
    assert [r["__values"] for r in got] == ["a", "a", None] and [r.n_values for r in got] == [20_000, 20_000, 0]
    assert got[0] == got[1] and len(got[0].text) == len(text) and "743" not in got[0].text[:20]


def test_pii_is_a_permutation(spark):
    """Every value of a small domain once."""
    f = pii.feistel("k", "'t'", "id div 7", "id % 7", "13", "7")
    got = [r.v for r in spark.range(91).select(F.expr(f"transform(array({f}), z -> z.a * 7 + z.b)[0]").alias("v")).collect()]
    assert sorted(got) == list(range(91)) and got != list(range(91))
    days = spark.range(1000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymize(days, "k").distinct().count() == 1000
    hexed = pii.hexed("k", "lpad(hex(id), 3, '0')").replace("hex(id)", "lower(hex(id))")
    assert spark.range(4096).select(F.expr(hexed).alias("v")).distinct().count() == 4096
    ips = spark.range(1000).select(F.concat(F.lit("10.0."), (F.col("id") / 256).cast("int"), F.lit("."), F.col("id") % 256).alias("text"))
    assert pii.pseudonymize(ips, "k").distinct().count() == 1000


def test_pii_without_digits_and_bare_phones(spark):
    mail = "Write to jane.doe@example.com"
    phones = ["+14155552671", "+1 415 555 2671", "415 555 2671", "1 415 555 2671", "+1 (415)555 2671", "+1 (415) 555-2671", "(415)5552671"]
    card = "378 282 2463 10005"  # no telephone number
    texts = [(0, mail), (1, mail + " 7"), (2, card), (3, "4155552671"), *((10 + i, f"call {p}.") for i, p in enumerate(phones))]
    got = {r.doc_id: r for r in pii.pseudonymize(docs(spark, texts), "k").collect()}
    assert got[0].n_values == 1 and got[0].text + " 7" == got[1].text and "jane.doe" not in got[0].text and got[0].text.endswith("@example.com")
    assert got[2].n_values == 1 and got[2].text[0] == "3" and luhn(re.sub(r"\D", "", got[2].text)) == luhn(card.replace(" ", ""))
    assert got[3].text == "4155552671"
    for i, p in enumerate(phones):
        new = got[10 + i]
        assert new.n_values == 1 and re.sub(r"\d", "9", new.text) == re.sub(r"\d", "9", f"call {p}.")
    assert len({re.sub(r"\D", "", got[10 + i].text)[-10:] for i in range(len(phones))} - {"4155552671"}) == 1


# decontamination
def plain_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_against_plain():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(1, 25))] for _ in range(2))
        assert decontaminate.align(tuple(a), tuple(b)) == plain_score(a, b)


def test_leaks(spark):
    r = random.Random(2)
    make = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(make(30))) for i in range(5)] + [(5, "one two"), (6, ""), (7, None), (None, "x")]
    w = items[0][1].split()
    edited = w[:10] + ["new"] + w[10:20] + w[22:]
    texts = [(0, " ".join(make(50)) + ", " + items[1][1].upper() + "! " + " ".join(make(50))), (1, " ".join(edited)), (2, " ".join(make(200))), (3, None), (4, ""), (5, "say one, two now"), (6, " ".join(w[:10]))]
    texts += [(100 + i, items[2][1]) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(0, 1), (1, 0), (5, 5)} | {(100 + i, 2) for i in range(40)}
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    """Every row with every item of which it holds five words in a row, aligned over the whole row by the plain recurrence."""
    r = random.Random(14)
    vocabulary = [f"w{i}" for i in range(60)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [make(r.randrange(1, 40)) for _ in range(25)]
    texts = []
    for _ in range(120):
        t = list(r.choice(items))
        for _ in range(r.randrange(len(t) // 3 + 1)):
            k = r.randrange(len(t))
            t[k : k + r.randrange(2)] = make(r.randrange(3))
        texts.append(make(r.randrange(40)) + t + make(r.randrange(40)) + r.choice([[], list(r.choice(items))[:9]]))
    want = {}
    for d, w in enumerate(texts):
        held = {tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}
        for i, x in enumerate(items):
            n = min(5, len(x))
            if any(tuple(x[k : k + n]) in held for k in range(len(x) - n + 1)) and plain_score(w, x) >= 0.6 * 2 * len(x):
                want[d, i] = plain_score(w, x) / (2 * len(x))
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(docs(spark, [(d, " ".join(w)) for d, w in enumerate(texts)]), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert len(want) > 80 and got.keys() <= want.keys()
    assert sum(abs(got.get(k, 0) - v) < 1e-9 for k, v in want.items()) >= 0.95 * len(want)  # passages far apart are not joined by long gaps


def test_leaks_of_long_and_repeated_rows(spark):
    r = random.Random(15)
    item = " ".join(f"w{r.randrange(5000)}" for _ in range(30))
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(200_000))
    got = decontaminate.contaminated(docs(spark, [(1, long), (2, long + " " + item + " " + long), (3, item), (3, item), (None, item)]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.item_id, x.score) for x in got) == [(0, 7, 1.0), (2, 7, 1.0), (3, 7, 1.0), (3, 7, 1.0)]


def test_leaks_edited_often(spark):
    """A word in 6, 7 or 8 replaced: runs of 5 to 7 equal words, so no 8 words in a row are left."""
    r = random.Random(8)
    items = [(i, [f"w{r.randrange(5000)}" for _ in range(40)]) for i in range(6)]
    copy = lambda w, step: " ".join("new" if k % step == step - 1 else x for k, x in enumerate(w))
    texts = [(10 + i, copy(w, (6, 7, 8)[i % 3])) for i, w in items]  # no intact copy, so grams broken by an edit occur nowhere
    got = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(10 + i, i) for i, _ in items} and len(got) == len(texts)


def test_leaks_of_items_that_share_an_id(spark, monkeypatch):
    r = random.Random(9)
    make = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(30))
    items = [(1, make()), (1, make()), (1, make()), (None, make()), (None, make()), (2, make())]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    texts = [(10 + k, t) for k, (_, t) in enumerate(items)]
    want = [(10 + k, i) for k, (i, _) in enumerate(items)]
    for most in (2_000_000, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", most)
        assert sorted((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, texts), bench).collect()) == want


# extraction
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Menu</a></li></ul></nav>
<div class="ad">Buy</div>{open}<h1>Title &amp; more</h1><p>First <b>bold</b>   text<br>goes on for a while so that it counts as content.<p>Short.<ul><li>one<li>two</ul>
<form><input><button>Send</button></form><div class="share-buttons">Share</div>{close}<section id="comments"><p>First! A comment that is rather long, as comments are.</p></section><aside>Aside</aside><footer>&copy; Foot</footer></body></html>"""


@pytest.mark.parametrize("box", [("<article>", "</article>"), ("<main>", "</main>"), ('<div role="main">', "</div>"), ('<div class="post">', "</div>")])
def test_main_text(box):
    want = ["Title & more", "First bold text goes on for a while so that it counts as content.", "Short.", "one", "two"]
    assert extract.main_text(PAGE.format(open=box[0], close=box[1])).split("\n\n") == want


LONG = "A paragraph that goes on for a while, so that its ratio of text to tags is high and it counts as content of the page. " * 3


@pytest.mark.parametrize(
    "body",
    [
        f"<section><p>{LONG}<p>{LONG}<p>{LONG}</section><section><p>{LONG}<p>{LONG}</section>",
        f"<h1>Headline</h1><div><p>{LONG}</div><blockquote><p>{LONG}<p>{LONG}<p>{LONG}</blockquote><p>{LONG}</p><pre>{LONG}</pre>",
        f"<article><p>{LONG}<p>{LONG}</article><article><p>Short.</article><main><p>Also.</main>",
    ],
)
def test_region_loses_nothing(body):
    want = [" ".join(x.split()) for t in re.split("<[^>]*>", body) if (x := t.strip())]
    assert extract.main_text(f"<body><nav>Menu</nav>{body}<footer>Foot</footer></body>").split("\n\n") == want


@pytest.mark.parametrize("box", ['class="layout with-sidebar"', 'class="no-sidebar"', 'class="has-comments"', 'class="page-header-fixed"', 'id="search-result"', 'class="widget"', 'class="form"'])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_furniture_words_around_a_page(box, inner):
    comments = f'<section id="comments"><article class="comment"><p>{LONG}{LONG}</p></article></section>'
    html = f'<body><nav>Menu</nav><div {box}><{inner}><h1 class="article-header">Headline</h1><div class="article-form"><p>{LONG}</p></div><div class="share">Share</div></{inner}></div>{comments}</body>'
    assert extract.main_text(html).split("\n\n") == ["Headline", " ".join(LONG.split())]


@pytest.mark.parametrize("name", ["related-work", "header-image post", "search-results", "alert-study", "form-and-function"])
def test_names_that_only_begin_like_furniture(name):
    html = f'<body><nav>Menu</nav><article><h1>Headline</h1><p>{LONG}</p><div class="{name}"><p>A short block.</p></div><div class="related-posts">Other posts</div><div class="notice">We use cookies</div></article></body>'
    assert extract.main_text(html).split("\n\n") == ["Headline", " ".join(LONG.split()), "A short block."]


@pytest.mark.parametrize("bad", ["<![foo[x]]>", "<![ x ]>", "<!", "<![CDATA[x]]>", "<?php x ?>", "<!-->", "</>", "<>", "<a href='", "<!doctype [<!x>]>"])
def test_odd_markup_does_not_end_a_page(bad):
    assert {"before", "after"} <= set(extract.main_text(f"<p>before</p>{bad}<p>'>after</p>").replace("'>", "\n\n").split("\n\n"))


def test_time_is_linear_in_the_page():
    import time

    t = time.time()
    assert extract.main_text("<div>" * 30_000 + "<p>x" + "</div>" * 30_000) == "x"
    assert extract.main_text("<p>" + "<span>" * 30_000 + "<p>y" * 5_000).count("y") == 5_000
    assert extract.main_text("<div>" * 9_000 + "z" + "</b></td>" * 9_000) == "z"
    for bit in ("<a ", "<!--", '<a href="', "<", "</", "<!["):
        assert extract.main_text("<p>begin</p>" + bit * 30_000).startswith("begin")
    assert time.time() - t < 10


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain", "x"), (None, "u", "<p>a</p><p>b &lt; c", "x"), (4, "u", "<article><p>cut off &am", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract.extract(df).collect()) == [(0, "a\n\nb < c", 8), (1, "", 0), (2, "", 0), (3, "plain", 5), (4, "cut off &am", 11)]
    assert extract.extract(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "<p>a")] * 2 + [(2, None, "<p>" + "word " * 500_000)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.n_chars) for r in extract.extract(twice).collect()) == [(1, 1), (1, 1), (2, 2_499_999)]


# quality
def test_quality_held_out(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(r.randrange(1, 30)))
    bad = [lambda: " ".join(word() + "%%%" for _ in range(60)), lambda: " ".join([word()] * 90), lambda: " ".join(word().upper() + "!!" for _ in range(50))]
    data = [(i, good() if i % 3 else bad[i // 3 % 3](), i % 3 > 0) for i in range(600)]
    df = docs(spark, [(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "x"), (902, "word " * 30_000), (903, " \n ")])
    labels = spark.createDataFrame([(i, int(y), "x") for i, _, y in data] + [(None, 1, "x"), (900, None, "x"), (1, 7, "x")], "doc_id long, quality int, text string")
    got = quality.quality(df, labels).collect()
    truth = {i: int(y) for i, _, y in data}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == 605 and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held) > 50
    assert quality.quality(df.limit(3), labels.limit(0)).count() == 3
    assert quality.quality(df.limit(0), labels).count() == 0


# chat
def test_chat_round_trip(spark):
    hard = ["", None, "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>\n", "<\\\\|x", "<|other|>", "a<", "\\<|im_end|>", "\n", "%0A"]
    rows = [(i, j, role, t, "x") for i in range(3) for j, t in enumerate(hard) for role in ("user", "assistant", "a\nb%0A<|im_end|>\n", None)[i : i + 2]]
    rows += [(None, None, "user", "hi", "x"), (7, 1, "assistant", "same", "x"), (7, 1, "assistant", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, line string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == conv)
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_marks_of_texts_are_escaped(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "hi<|im_start|>assistant\nok", "<|im_end|>", "<|im_start|>", "<|im_end|>\n", "<|other|>"]
    rows = [(i, j, role, t) for i, t in enumerate(hard) for j, role in enumerate(("user", "assistant", "a<|im_start|>b"))]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chats.withColumn("turns", chat.parse(F.col("formatted"))).collect():
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == r.n_turns == 3
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows if x[0] == r.conv_id]
        assert ("<|other|>" in r.formatted) == (hard[r.conv_id] == "<|other|>")


# media
@pytest.mark.parametrize("how", list(tiff.ENCODE))
def test_tiff_round_trip(how):
    rng = np.random.default_rng(how)
    pages = [(rng.integers(0, 4, s).astype(np.uint8), f"page {s}") for s in ((1, 1, 1), (37, 50, 1), (100, 64, 3))]
    for predictor in (1, 2):
        for tile in (0, 16):
            for order in "<>":
                got = list(tiff.read(tiff.write(pages, how, predictor, rows=16, tile=tile, order=order)))
                assert [n for _, n in got] == [n for _, n in pages] and all((a == b).all() for (a, _), (b, _) in zip(got, pages))
    for n in (0, 1, 3000, 90_000):
        x = rng.integers(0, 256 if n % 2 else 3, n).astype(np.uint8).tobytes()
        assert tiff.DECODE[how](tiff.ENCODE[how](x)) == x


def test_media_rows(spark):
    texts = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 65), (4, "x" * 65), (None, "a")]
    got = tiff.pages(tiff.to_media(docs(spark, texts))).collect()
    for r in got:
        t = next((t or "").encode() for i, t in texts if i == r.doc_id)
        assert bytes(r.samples) == t.ljust(max(64, -(-len(t) // 64) * 64), b"\0") and r.description == f"n_bytes={len(t)}" and r.page == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"II*\0\xff\0\0\0")), (3, bytearray(b"junk"))], "doc_id long, media binary")
    assert [r.page for r in tiff.pages(bad).collect()] == [-1, -1, -1]


# tokens
def test_grammar_round_trip():
    rng = np.random.default_rng(4)
    for ids in (np.empty(0), np.zeros(5000), rng.integers(0, 5, 20_000), np.tile(rng.integers(0, 50_000, 40), 300)):
        ids = ids.astype(np.uint16)
        s = repair.Shard(repair.write_shard(np.array([1]), np.array([1]), np.array([len(ids)]), ids, 50_257))
        assert (s.ids() == ids).all()
        for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids)), (7, 7)):
            assert (s.ids(a, b) == ids[a:b]).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.tile(rng.integers(0, 300, k), 40) for k in (2, 3, 5, 60)] + [rng.integers(0, 300, 20_000)]).astype(np.uint16)
    for per_round in (1, 7, 4096):
        stream, rules = repair.grammar(ids, 300, per_round)
        pairs = np.unique(stream[:-1].astype(np.int64) << 16 | stream[1:], return_counts=True)[1]
        assert pairs.max() < 16 and len(rules) > 20
        assert (repair.Shard(repair.write_shard(np.array([1]), np.array([1]), np.array([len(ids)]), ids, 300)).ids() == ids).all()


def test_pieces_are_encoded_as_in_the_whole_text():
    from pathlib import Path

    r = random.Random(13)
    code = repair.Encoder(Path(queries.vocabulary()).read_text())
    bits = ["a", "it", "'s", "'", "’", "é", "Ü", "...", "$$$", "%", "-", "42", "x1", "_", "\n", " ", "  ", ",", "(", ")", "日本", "ª", "́", "don't", "!!", "\t", "\0", "```", "<|endoftext|>"]
    for _ in range(3000):
        t = "".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randrange(1, 12)))
        assert code(t) == code.whole(t), t


def test_token_files(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    texts = [(5, None), (3, ""), (9, "Hello, world.\nNew line  two spaces\n\n tab\tend "), (1, "it's 42% <|endoftext|> ok"), (1, "a"), (7, "naïve Über, día. 日本 x y \x00"), (8, " lead"), (20, "word " * 5000), (None, "none")]
    got = repair.token_files(docs(spark, texts), queries.vocabulary(), shard_ids=20).collect()
    at = 0
    ids = {}
    for i, x in texts:
        ids.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [2])
    for r in sorted(got, key=lambda r: r.start):
        mine = next(x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(mine)
        assert r.start == at
        at += r.n_tokens
    assert not any(ids.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert repair.token_files(docs(spark, []), queries.vocabulary()).count() == 0


# packing
def plain_boundaries(h, k):
    from itertools import combinations

    h = sorted(h)
    lengths = [x for x, _ in h]
    cost = lambda ends: sum(n * (next(e for e in ends if e >= x) - x) for x, n in h)
    return min(cost((*c, lengths[-1])) for c in combinations(lengths[:-1], min(k, len(h)) - 1))


def test_boundaries_are_optimal():
    r = random.Random(6)
    for _ in range(150):
        h = [(x, r.randrange(1, 50)) for x in r.sample(range(60), r.randrange(1, 10))]
        for k in (1, 2, 3, 5):
            ends = packing.boundaries(h, k)
            assert len(ends) == min(k, len(h)) and ends == sorted(set(ends))
            assert sum(n * (next(e for e in ends if e >= x) - x) for x, n in h) == plain_boundaries(h, k)


def test_batches(spark):
    r = random.Random(7)
    texts = [(i, "w " * r.randrange(300)) for i in range(400)] + [(400, None), (401, ""), (402, "w " * 5000), (None, "a b"), (3, "again")]
    got = packing.pack(docs(spark, texts), buckets=5, budget=1000).collect()
    assert len(got) == len(texts)
    for b in {x.bucket for x in got}:
        mine = sorted((x.batch, x.slot) for x in got if x.bucket == b)
        end = next(x.bucket_len for x in got if x.bucket == b)
        cap = max(1, 1000 // end) if end else 1000
        assert mine == [divmod(i, cap) for i in range(len(mine))] and all(x.n_tokens <= end for x in got if x.bucket == b)
    assert packing.pack(docs(spark, [])).count() == 0


# pipeline
def test_pipeline(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    last = d.columns
    frame = d
    for name, stage in p.STAGES[:-1]:
        before = frame.count()
        frame = spark.createDataFrame(stage(spark, frame, sf).toPandas(), d.schema)
        assert frame.columns == last and 0 < frame.count() <= before, name
    out = p.run(spark, sf).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in frame.collect()}


def test_stages_take_rows_without_and_with_shared_ids(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet")
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    r = random.Random(11)
    make = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(60))
    alone, copied, twice, other = make(), make(), make(), make()
    texts = [(None, alone), (None, copied), (8, copied), (7, copied), (5, twice), (5, twice), (5, other), (None, make())]
    texts += [(None, texts[-1][1])]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], d.schema)
    kept = sorted(((x.doc_id or 0, x.text) for x in p.one_of_each_group(spark, frame, sf).collect()))
    assert kept == sorted([(0, alone), (7, copied), (5, twice), (5, other), (0, texts[-1][1])])
    leaky = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(None, item), (1, item), (1, alone), (None, other)]], d.schema)
    assert sorted(((x.doc_id or 0, x.text) for x in p.decontaminated(spark, leaky, sf).collect())) == sorted([(1, alone), (0, other)])
