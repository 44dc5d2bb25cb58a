"""Operators on single texts: url rules, main text, packing, pieces, personal data, rules, media."""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import random
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodscape.llm import common, html_text, media, packing, pii, queries, rules, sentencepieces, substrings, url_rules
from lodscape.llm.common import public_vocabulary

TEXTS = [None, "", " ", "\n", "a", "Grüße aus Köln", "x " * 5000, "日本 語 🙂", "same text here", "same text here"]


def corpus(spark, texts=TEXTS):
    rows = [(k, t, "en", "s", 0, "clash", "clash") for k, t in enumerate(texts)] + [(None, "no id", None, None, None, "clash", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, media string")


# --- 1: url rules ------------------------------------------------------------------------------


def judged(url, rules_):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules_:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return host, path, best[1] if best else None, best[0] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "https://a.Example.ORG/es/x?y#z", "https://example.org/es", "https://example.org/en/12", "http://example.com/fr/1", "http://example.com/de/1",
    "http://notexample.org/es/", "http://org/", "http://x.org/es/", "ftp://EXAMPLE.org#a", "a://b://c.org/", "http://com", "http://.org/", "http://a..com/fr/", "http://org.net/", "http://ÉXAMPLE.org/es/",
]


def test_url_rules(spark):
    rows = [(k, u, "clash", "clash") for k, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.apply_url_rules(pages, queries.URL_RULES).collect()}
    assert len(got) == len(rows)
    for k, u, *_ in rows:
        assert got[k] == judged(u, queries.URL_RULES), u
    assert url_rules.apply_url_rules(pages, []).where("verdict <> 'allow' or rule is not null").count() == 0
    assert url_rules.apply_url_rules(pages.limit(0), queries.URL_RULES).count() == 0


def test_equal_rules_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x" + "y" * 200_000), (2, "http://" + "a." * 50_000 + "org/x"), (3, "http://b.org/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"], len(r["host"])) for r in url_rules.apply_url_rules(pages, [("allow", "a.org/x"), ("block", "a.org/x")]).collect()}
    assert got == {1: ("a.org/x", "block", 5), 2: ("a.org/x", "block", 100_003), 3: (None, "allow", 5)}


def test_nested_hosts(spark):
    nested = [("allow", "a.b.c/"), ("block", "b.c/"), ("allow", "c/"), ("block", "z.b.c/x/")]
    pages = spark.createDataFrame([(k, f"http://{h}/{p}") for k, (h, p) in enumerate([("a.b.c", "1"), ("q.a.b.c", ""), ("z.b.c", "x/1"), ("z.b.c", "y"), ("c", ""), ("cc", ""), ("d", "")])], "page_id long, url string")
    for r in url_rules.apply_url_rules(pages, nested).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], nested)


# --- 2: main text ------------------------------------------------------------------------------

ARTICLE = "<h2>Head</h2><p>One, two, three: a long paragraph that goes on, and on, until its end is reached.</p><p>Short &amp; sweet.</p><ul><li>first<li>second</ul>"
EXPECTED = "Head\nOne, two, three: a long paragraph that goes on, and on, until its end is reached.\nShort & sweet.\nfirst\nsecond"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=x>Home</a></nav><article>{ARTICLE}</article><footer>&copy; us</footer></body>",
        f"<html><head><title>t</title><script>var a='</p>';</script></head><body class='has-sidebar'><div id='cookie-notice'>We use cookies, many, many.</div><div class='content has-ads'>{ARTICLE}</div><div class='sidebar'><p>side, side, side, side, side, side, side</p></div>",
        f"<main><div class='wrap'>{ARTICLE}<div class='ad-slot'>BUY, BUY, BUY NOW</div><form><p>Your name, please</p></form></div><section id='comments'><article class=comment><p>Great, great, great post, thanks a lot for it.</p></article></section></main>",
        f"<!-- <p>no</p> --><article>{ARTICLE}<aside>by the way, this, that</aside><noscript>no</noscript><div style='display: none'>hidden</div></article>",
        f"<article>{ARTICLE}<ul><li><a href=1>More one</a><li><a href=2>More two</a></ul></article>",
    ],
)
def test_main_text(page):
    assert html_text.main_text(page) == EXPECTED


P = "<p>One, two, three: a long paragraph that goes on, and on, until its end is reached, at last.</p>"


@pytest.mark.parametrize(
    "page,paragraphs",
    [
        (f'<div class="search-results">{P}{P}</div>', 2),
        (f'<div class="discussion form-page">{P}{P}</div>', 2),
        (f'<article>{P}{P}{P}<section class="related-work">{P}</section></article>', 4),
        (f'<div class="newsletter-archive"><article>{P}{P}</article></div>', 2),
        (f'<div class="cookie-banner">{P}</div>', 1),
        (f'<article>{P}<div class="comments">{P}{P}{P}</div></article>', 1),
        (f'<div class="post">{P}{P}</div><div id="comments">{P}{P}{P}{P}</div>', 2),
        (f'<article>{P}{P}<div class="related"><a href=x>More, of, this, long, link, text, for, you</a></div></article>', 2),
        (f'<article>{P}{P}<div class="ad">Buy, buy, buy this now, it is a bargain</div></article>', 2),
    ],
)
def test_class_words_never_empty_a_page(page, paragraphs):
    assert html_text.main_text(page) == "\n".join([re.sub("<.*?>", "", P)] * paragraphs)


@pytest.mark.parametrize(
    "page,expected",
    [
        (f'<article>{P}<div class="notice">{P}</div>{P}</article>', [P, P]),
        (f'<article>{P}<div class="sponsored">{P}</div><div class="share-box">{P}</div><form class="contact">{P}</form></article>', [P]),
        (f'<article><p>Short note, one line.</p></article><div class="comments">{P}{P}</div>', ["Short note, one line."]),
        (f'<article><p>Short note, one line.</p></article><div class="sidebar">{P}{P}</div>', ["Short note, one line."]),
        (f'<body><form id="aspnetForm"><div class="top"><label>Find</label><input><button>Go</button></div><div class="page">{P}{P}</div></form></body>', [P, P]),
        (f'<div class="comments">{P}{P}</div>', []),
        (f'<h1>Head</h1><div class="newsletter-archive">{P}{P}</div>', [P, P]),
    ],
)
def test_notices_comments_and_forms(page, expected):
    assert html_text.main_text(page) == "\n".join(re.sub("<.*?>", "", p) for p in expected)


@pytest.mark.parametrize("page,expected", [(None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain &lt;text&gt;  here\n", "plain <text> here"), ("<p>a < b and c", "a < b and c"), ("<p>a<br>b<p title='x>y'>c", "a b\nc"), ("<b><i></b></i></x>", "")])
def test_odd_pages(page, expected):
    assert html_text.main_text(page) == expected


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/!-&;\"' apdivtrlscf=x\n")), max_size=200))
def test_any_page_is_read(page):
    assert isinstance(html_text.main_text(page), str)


def test_long_pages_take_linear_time():
    for part in ("<div>", "<p>x", "</x>", "<!-- ", '<a "', "<table><tr><td>x"):
        html_text.main_text(part * 20_000)


def test_extract_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, None, "old", 5), (2, "<p>a, b</p>", "old", 5), (2, "<p>a, b</p>", "old", 5)], "page_id long, html string, text string, other int")
    out = html_text.extract_main_text(pages)
    assert out.columns == ["page_id", "html", "other", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "", 0), (2, "a, b", 4), (2, "a, b", 4)]


def test_pages_of_the_fixture(spark, sf):
    for r in queries.op2_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer)", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h\d)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- 5: packing --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))


ODD_TEXTS = ["<|endoftext|> a", "ΑΣ ας İx", "e\u0301 E\u0301", "a\u00a0b\x1cc\u2003d", "it's we'll 'S _x_ a_b 12 ½ ² x²", "\x00a \x7f", "日本 語", "ＡＢ", "“q” µ ª º ×÷ Ÿ ĳ", "ſ K Å", "x" * 3000]


def test_ids_are_the_tokenizers(tokenizer):
    encode = packing.word_encoder(public_vocabulary("word_bpe_49k.json"))
    for t in [x for x in TEXTS if x] + ODD_TEXTS:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_missing_words_are_encoded_at_once(tokenizer, monkeypatch):
    encoder = packing.WordEncoder(public_vocabulary("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "_KNOWN", 40)
    monkeypatch.setattr(packing, "_AT_ONCE", 300)
    texts = [x for x in TEXTS if x] + ODD_TEXTS + ["we'll Été ÀÞ 1a2 x~!", "", "a<|endoftext|>b c", "we'll Été"] * 2
    got = encoder.encode([None, *(t.encode() for t in texts)])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[]] + [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder._older) > 0 and encoder.encode([]) == []
    assert not [w for w in [*encoder._known, *encoder._older] if len(w) > 64]


def test_remembered_words_change_no_ids():
    path = public_vocabulary("word_bpe_49k.json")
    few, many = packing.WordEncoder(path, 40), packing.WordEncoder(path)
    for k in range(0, 2000, 20):
        text = " ".join(f"w{i}x{i * i}" for i in range(k, k + 20)).encode()
        assert few(text) == many(text)
    assert len(few._known) + len(few._older) <= 40 < len(many._known)


def test_words_are_looked_up_once_and_the_tokenizer_only_read_for_odd_ones(tokenizer, monkeypatch):
    """However often a word occurs in texts encoded at once, it is looked up once; words beyond Latin-1 alone need the whole tokenizer."""
    encoder, asked = packing.WordEncoder(public_vocabulary("word_bpe_49k.json")), []
    ids_of = encoder._ids_of
    monkeypatch.setattr(encoder, "_ids_of", lambda words: asked.extend(words) or ids_of(words))
    texts = ["  same\t\tsame \x0bwords\x0c", "", "words we'll Été", None, "\x1fa\x1cb same"]
    whole = pa.array(["cut off", *texts, "cut off"])
    raw = whole.slice(1, len(texts)).cast(pa.binary())
    for column in (whole.slice(1, len(texts)), raw):
        got = [np.frombuffer(x, "<u4").tolist() for part in encoder.encode_column(column) for x in part]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    plain = packing.WordEncoder(public_vocabulary("word_bpe_49k.json"))
    assert plain.encode([b" a b ", b"\xc3\x89t\xc3\xa9"]) and "_tokenizer" not in vars(plain)
    assert plain.encode(["日本".encode()]) and "_tokenizer" in vars(plain)
    assert len(asked) == 2 * len(set(asked)) and asked.count(b"same") == 2


def test_texts_encoded_at_once_change_no_ids_and_bound_memory():
    """Texts of 1.6 MB of different words: a worker that encodes 16 KB at once takes far less memory, for the same ids."""
    path = public_vocabulary("word_bpe_49k.json")
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(200)) for k in range(800)] + [None, "x " * 20_000])
    found = []
    for at_once in (1 << 14, None):
        encoder, ids = packing.WordEncoder(path, 2_000, at_once), hashlib.sha256()
        encoder._of_words([b"warm"])
        tracemalloc.start()
        sizes = []
        for part in encoder.encode_column(texts):
            sizes.append(len(part))
            for x in part:
                ids.update(x + b"|")
        found.append((ids.hexdigest(), sum(sizes), tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
        assert len(sizes) > 50 if at_once else len(sizes) == 1
    assert found[0][:2] == found[1][:2] and found[0][1] == len(texts) and 10 * found[0][2] < found[1][2], found


def test_later_stages_do_not_hold_what_earlier_ones_remembered():
    packing.word_encoder(public_vocabulary("word_bpe_49k.json"), 1000)
    assert "value" in common._kept
    list(substrings._units(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [b"a b"]})])))
    assert not common._kept


def test_vocabulary_whose_merges_go_another_way_is_refused(tmp_path):
    whole = json.loads(Path(public_vocabulary("word_bpe_49k.json")).read_text())
    whole["model"]["merges"].reverse()
    (tmp_path / "v.json").write_text(json.dumps(whole))
    with pytest.raises(ValueError):
        packing.WordEncoder(str(tmp_path / "v.json"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(t):
    from tokenizers import Tokenizer

    own = test_ids_of_any_text.__dict__.setdefault("own", (Tokenizer.from_file(public_vocabulary("word_bpe_49k.json")), packing.word_encoder(public_vocabulary("word_bpe_49k.json"))))
    try:
        raw = t.encode()
    except UnicodeEncodeError:
        return
    assert np.frombuffer(own[1](raw), "<u4").tolist() == own[0].encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_bins(lengths):
    bins = packing.fill_bins(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= max(-(-sum(lengths) // 64), int(11 / 9 * -(-sum(lengths) // 64)) + 4, sum(2 * n > 64 for n in lengths) + 2) + len(lengths) // 6


def fewest_bins(lengths, capacity):
    """By trying every way to fill one bin after the other."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for b in range(len(room)):
            if room[b] >= lengths[i] and room[b] not in room[:b]:
                go(i + 1, room[:b] + [room[b] - lengths[i]] + room[b + 1 :])
        go(i + 1, [*room, capacity - lengths[i]])

    go(0, [])
    return best


def test_bins_are_close_to_the_fewest():
    r, more = random.Random(17), 0
    for _ in range(120):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 11))]
        got, least = len(packing.fill_bins(lengths, 64)), fewest_bins(lengths, 64)
        assert least <= got <= least + 1
        more += got - least
    assert more <= 3


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(k, 1 + k % 7, "g", None, k) for k in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, _group string, _left string, _row long")
    out = packing.pack(pieces, size=10, group_rows=50)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and sorted((x["doc_id"], x["length"], x["_group"], x["_left"], x["_row"]) for x in out.collect()) == rows
    assert packing.pack(pieces.limit(0)).count() == 0


def test_small_documents_fill_their_bins():
    r = random.Random(8)
    lengths = [r.choice([r.randint(1, 60), r.randint(100, 2048)]) for _ in range(3000)]
    assert len(packing.fill_bins(lengths, 2048)) == -(-sum(lengths) // 2048)


def test_packing_whole(spark, tokenizer):
    texts = TEXTS + ["wort " * 5000] + ["tiny"] * 50
    docs = corpus(spark, texts)
    for out in (packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json")), packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"), size=16)):
        size = 2048 if out.agg(F.max("length")).first()[0] > 16 else 16
        by_doc, by_bin = {}, {}
        for r in out.collect():
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert len(ids) == r["length"] <= size and r["start"] == r["piece"] * size
            by_doc.setdefault(r["doc_id"], []).append((r["piece"], ids))
            by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for k, t in [*enumerate(texts), (None, "no id")]:
            whole = [i for _, ids in sorted(by_doc[k]) for i in ids]
            assert whole == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for spans in by_bin.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= size
    assert packing.pack_documents(docs.limit(0), public_vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_in_rounds(spark):
    r = random.Random(2)
    rows = [(k, r.randint(1, 2048) if k % 3 else r.randint(1, 40)) for k in range(3000)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long").repartition(7), group_rows=100).collect()
    fills = {}
    for x in out:
        fills[x["sequence_id"]] = fills.get(x["sequence_id"], 0) + x["length"]
    assert sorted((x["doc_id"], x["length"]) for x in out) == rows and max(fills.values()) <= 2048
    assert len(fills) <= -(-sum(n for _, n in rows) // 2048) * 1.03


# --- 7: personal data --------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if "0" <= c <= "9"]
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [
    "mail a.b@c.de, x@y@z.com! a@b.c_d@e.f 🙂 é@é.fr me@x.y.z.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 01.002.255.0 1.2.3", "card 4785 3805 9239 1139 and 4785380592391139 and 4785380592391138 00", "+49 (30) 123-4567 +1 2 +123456789012345678 call +44 20 7946 0958.",
    "IBAN DE89 3704 0044 0532 0130 00 account, GB82WEST12345698765432, DE88370400440532013000", "ssn 123-45-6789 and 000-12-3456", "tel 555-123-4567 now", "order 555-123-4567", "@" * 3000, "1" * 5000, "1 " * 3000, "+1" * 2000, "a@" * 2000,
]


def test_personal_data(spark):
    docs = corpus(spark, TEXTS + PII)
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for k, t in enumerate(TEXTS + PII):
        text = lambda spans: [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
        assert text(got[k]["pii_base"]) == base_spans(t), t
        assert set(base_spans(t)) <= set(text(got[k]["pii"]))
        assert all((t or "")[s["start"] : s["end"]] == s["text"] for s in got[k]["pii"])
    kinds = {k: {s["kind"] for s in got[len(TEXTS) + k]["pii"]} for k in range(len(PII))}
    assert "iban" in kinds[4] and kinds[5] == {"national_id"} and kinds[6] == {"phone"} and kinds[7] == set()
    digest = {r["doc_id"]: r for r in pii.personal_data_digest(pii.find_personal_data(docs)).collect()}
    assert (digest[len(TEXTS)]["n_email"], digest[len(TEXTS) + 1]["n_ip"]) == (len([s for s in base_spans(PII[0])]), len(base_spans(PII[1])))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("0123456789.@+- ()ab_é🙂")), max_size=60), min_size=300, max_size=300))
def test_base_patterns_on_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).select("text", F.expr("transform(pii_base, x -> concat(x.kind, ':', x.start, ':', x.end))").alias("s")).collect():
        assert r["s"] == base_spans(r["text"]), r["text"]


LONG = ["1.2.3.4 ", "tel 555-123-4567 ", "4785 3805 9239 1139 x", "+49 30 1234567 x", "a@b.cd "]


def test_many_spans_in_long_texts(spark):
    for part in LONG:
        began = time.monotonic()
        found = pii.find_personal_data(spark.createDataFrame([(1, part * 20_000)], "doc_id long, text string"))
        assert found.select(F.size("pii")).first()[0] == 20_000
        masked = pii.mask_personal_data(spark.createDataFrame([(1, part * 20_000)], "doc_id long, text string")).first()["text"]
        assert masked.count("<") == 20_000 and not re.search("[0-9]|@", masked)
        assert time.monotonic() - began < 40


def test_personal_data_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(k, t, "p", "q", "r", "s") for k, t in [(1, PII[0]), (1, PII[0]), (2, None), (None, PII[1])]], "doc_id long, text string, t string, pii string, _t string, spans string")
    out = pii.find_personal_data(docs)
    assert out.columns == ["doc_id", "text", "t", "_t", "spans", "pii_base", "pii"] and out.count() == 4 and {(x["t"], x["_t"], x["spans"]) for x in out.collect()} == {("p", "r", "s")}
    assert pii.mask_personal_data(docs).columns == docs.columns and {tuple(x)[2:] for x in pii.mask_personal_data(docs).collect()} == {("p", "q", "r", "s")}
    assert pii.find_personal_data(docs.limit(0)).count() == pii.mask_personal_data(docs.limit(0)).count() == 0


def test_masks_replace_the_merged_spans(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice([*PII[:8], "é🙂 words", "+4785380592391139", "x@1.2.3.4"]) for _ in range(r.randint(1, 60))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x["doc_id"]: x["pii"] for x in pii.find_personal_data(docs).collect()}
    for x in pii.mask_personal_data(docs).collect():
        out, at, t = "", 0, texts[x["doc_id"]]
        for s in sorted(spans[x["doc_id"]], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= at:
                out += t[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert x["text"] == out + t[at:]


def test_masking(spark):
    docs = corpus(spark, ["mail me@x.org and +49 30 1234567 now", None, "nothing", "4785380592391139"])
    got = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(docs).collect()}
    assert got[0] == "mail <EMAIL> and <PHONE> now" and got[1] is None and got[2] == "nothing" and got[3] == "<CARD>" and got[None] == "no id"
    assert pii.mask_personal_data(docs).columns == docs.columns


# --- 8: pieces ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return sentencepieces.PieceCodec(public_vocabulary("piece_bpe_32k.model"), commit_every=8)


@pytest.fixture(scope="module")
def processor():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_vocabulary("piece_bpe_32k.model"))


def test_long_texts_without_spaces():
    from sentencepiece import SentencePieceProcessor

    model = public_vocabulary("piece_bpe_32k.model")
    own, library = sentencepieces.PieceCodec(model), SentencePieceProcessor(model_file=model)
    for characters in ("日本語文字列中国人民大学生活", "ไทยภาษากขคงจฉชซ", "🙂🙃🚀🌍🎉"):
        short, long = ("".join(characters[k * k % len(characters)] for k in range(n)) for n in (1000, 100_000))
        assert np.frombuffer(own.encode(short), "<u4").tolist() == library.encode(short)
        assert own.decode(own.encode(long)) == long


PIECES = [" ", "  ", " a", "a ", "\n", "\n\na", "a\tb\nc", "▁▁x", "aaaaaaaaaaaaaaaa" * 30, "lalala" * 90, "0000000123", "========----====", "x  y\n  z ", "\x00\x01", "é🙂日本", "it's  code      here"]


def test_pieces_are_the_models(codec, processor):
    r = random.Random(1)
    texts = [t for t in TEXTS if t] + ODD_TEXTS + PIECES + ["".join(r.choice("aab  the.=-/\n0é▁") for _ in range(r.randint(1, 300))) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == processor.encode(t), t
        assert codec.decode(codec.encode(t)) == t.replace("▁", " ")


def test_neighbouring_pieces_are_judged_without_merging(processor, monkeypatch):
    own, r = sentencepieces.PieceCodec(public_vocabulary("piece_bpe_32k.model")), random.Random(3)
    short = [p for p in own._whole if len(p) < 5]
    pairs = [(a, b) for a, b in (r.sample(short, 2) for _ in range(20_000)) if a[-1] + b[0] in own._joined] + [(a, a) for a in short]
    wanted = [own._merged(a + b) == [a, b] for a, b in pairs]
    assert [own._own_pair(a, b) for a, b in pairs] == wanted and 0 < sum(wanted) < len(wanted)
    monkeypatch.setattr(own, "_merged", None)
    text = " ".join("".join(r.choice("etaonish") for _ in range(r.randint(1, 12))) for _ in range(2000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == processor.encode(text)


def test_few_remembered_pairs_give_the_same_ids(codec, processor, monkeypatch):
    monkeypatch.setattr(sentencepieces, "_PAIRS", 5)
    own = sentencepieces.PieceCodec(public_vocabulary("piece_bpe_32k.model"))
    text = "the longer words of these sentences, " * 3 + "thelongword" * 40
    assert np.frombuffer(own.encode(text), "<u4").tolist() == processor.encode(text)
    assert sum(map(len, own._after.values())) <= 5


def test_long_units_commit_as_their_paths_meet(processor, monkeypatch):
    own, met = sentencepieces.PieceCodec(public_vocabulary("piece_bpe_32k.model")), []
    real = own._meeting
    monkeypatch.setattr(own, "_meeting", lambda sizes, committed: met.append(real(sizes, committed)) or met[-1])
    text = "".join(random.Random(2).choice("thelongword") for _ in range(20_000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == processor.encode(text) and len(met) > 100


def test_stream_commits_early_and_alike(codec):
    text = "▁" + "thelongword" * 500
    parts = list(codec.stream(text[i : i + 7] for i in range(0, len(text), 7)))
    assert len(parts) > 50 and b"".join(parts) == b"".join(codec.stream([text]))


def test_piece_columns(spark):
    model = public_vocabulary("piece_bpe_32k.model")
    docs = corpus(spark)
    out = sentencepieces.decode_pieces(sentencepieces.encode_pieces(docs, model), model)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "decoded"}
    for r in out.collect():
        assert r["decoded"] == (r["text"] or "")
    assert sentencepieces.encode_pieces(docs.limit(0), model).count() == 0


# --- 9: rules ----------------------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rule_counts(spark):
    r = random.Random(6)
    texts = TEXTS[:6] + TEXTS[7:] + ["a b " * 60, "l\nl\n\n \nl", "#$% & x|<y>", "\x0b\x0c\x1c\x85\u2003"] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 90))) for _ in range(40)]
    got = {x["doc_id"]: x for x in rules.judge_quality(corpus(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = counts(t)
        x = got[k]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, t
        assert x["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x["base_failed"] and x["kept"])
    assert rules.judge_quality(corpus(spark).limit(0)).count() == 0


def slow_distance(counts, reference):
    total, whole = sum(counts), sum(reference)
    if not total:
        return 0.0
    out = 0.0
    for c, r in zip(counts, reference):
        p, q = c / total, r / whole
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return math.sqrt(max(out, 0))


def test_distances(spark, sf):
    r = random.Random(3)
    for _ in range(50):
        rows = [[r.choice([0, 0, 1, 5, 90]) for _ in range(9)] for _ in range(4)] + [[0] * 9]
        reference = [r.random() * r.choice([0, 1]) + 1e-9 for _ in range(9)]
        assert np.allclose(rules.jensen_shannon(np.array(rows, float), reference), [slow_distance(x, reference) for x in rows], atol=1e-7)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = {x["doc_id"]: (x["lang"], rules.profile_of(x["text"])) for x in docs.collect()}
    shares = {}
    for lang, p in profiles.values():
        if lang in rules.COMMON_WORDS and p[0]:
            shares.setdefault(lang, []).append([np.array(p[k]) / max(1, sum(p[k])) for k in (5, 6)])
    references = [[np.mean([s[k] for s in v], axis=0) for v in shares.values()] for k in (0, 1)]
    for x in rules.judge_quality(docs).collect():
        p = profiles[x["doc_id"]][1]
        want = [min(slow_distance(p[5 + k], q) for q in references[k]) for k in (0, 1)]
        assert abs(x["class_distance"] - (want[0] if p[1] >= 200 else 0)) < 1e-6 and abs(x["word_distance"] - (want[1] if p[0] >= 60 else 0)) < 1e-6
        assert x["kept"] == (not x["base_failed"] and x["class_distance"] <= 0.27 and x["word_distance"] <= 0.40)


def test_rules_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 100_000, "en", "p", "q", 5), (2, None, None, "p", "q", 5), (2, None, None, "p", "q", 5)], "doc_id long, text string, lang string, classes string, common string, n_words int")
    out = rules.judge_quality(docs)
    assert out.columns[:5] == ["doc_id", "text", "lang", "classes", "common"] and out.columns.count("n_words") == 1
    assert {(x["classes"], x["common"]) for x in out.collect()} == {("p", "q")} and out.count() == 3


def test_rules_keep_the_clean_and_drop_noise(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged_ = rules.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert judged_.where("quality = 1 and not kept").count() == 0
    assert judged_.where("quality = 0 and not kept").count() > 0


# --- 10: media ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=900), st.integers(0, 200_000).map(lambda n: bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)))))
def test_streams_round_trip(payload):
    stored = media.to_transport_stream(payload)
    read = media.read_transport_stream(stored)
    assert len(stored) % 188 == 0 and read.payload == payload and not read.damaged and not read.discontinuities
    assert [u[0] for u in read.units] == [k * media.UNIT_TICKS for k in range(len(read.units))]
    assert [u[3] for u in read.units] == [k % media.RANDOM_ACCESS_EVERY == 0 for k in range(len(read.units))]


def test_media_of_no_rows_and_any_columns(spark):
    docs = spark.createDataFrame([(1, None, "a", "b"), (1, None, "a", "b"), (2, "", "a", "b")], "doc_id long, text string, media string, units string")
    rows = [tuple(x)[1:] for x in media.media_digest(docs).collect()]
    assert len(rows) == 3 and len(set(rows)) == 1 and media.media_digest(docs.limit(0)).count() == 0


def test_damage_is_counted():
    stored = media.to_transport_stream(b"x" * 100_000)
    lost = media.read_transport_stream(stored[: 188 * 5] + stored[188 * 6 :])
    assert lost.discontinuities == 1 and lost.damaged == 1
    twice = media.read_transport_stream(stored[: 188 * 6] + stored[188 * 5 :])
    assert twice.payload == b"x" * 100_000 and twice.discontinuities == 0
    bad = bytearray(stored)
    bad[188 + 30] ^= 1
    assert media.read_transport_stream(bytes(bad)).damaged >= 0
    assert media.read_transport_stream(None).payload == b"" and media.read_transport_stream(b"abc").damaged == 1


def test_media_digest(spark):
    import hashlib

    texts = TEXTS + ["é" * 70_000]
    for r in media.media_digest(corpus(spark, texts)).collect():
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_transport_stream(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and r["feature"].endswith("discontinuities=0;damaged=0")
