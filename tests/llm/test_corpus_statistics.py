"""Operators on statistics of the whole corpus: collocations, aligned tokenizers, license scans."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodscape.llm import alignment, blocks, collocations, licenses, queries
from lodscape.llm.common import public_vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11: collocations --------------------------------------------------------------------------


def phrases(rows, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    candidates = {k for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = {(g, w[i : i + k]) for g, w in candidates for k in range(2, len(w)) for i in range(len(w) - k + 1) if f[g, w[i : i + k]] == f[g, w]}
    out = []
    for lang in n:
        rows = []
        for g, w in candidates - inside:
            if g == lang:
                score, _, left, right = min((1000 * f[g, w] * n[g] // (f[g, w[:c]] * f[g, w[c:]]), c, f[g, w[:c]], f[g, w[c:]]) for c in range(1, len(w)))
                rows.append((-score, -f[g, w], " ".join(w).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


PROSE = [
    ("en", "New York is big. new york, New York; the new york times says: new york times"),
    ("en", "a a a a a a a\tb  b\nb\x0bb\x0cb\rb a a"),
    ("en", "of the the of the. of the? the of"),
    ("de", "über den Wolken, über den wolken! Über den Wolken über den"),
    (None, "a b a b a b a b"), ("und", "a b a b"), ("fr", None), ("fr", ""), ("fr", " \t.,;"), ("en", " x   x "),
]


def mined(df, **settings):
    return sorted(tuple(r) for r in collocations.mine_collocations(df, **settings).collect())


def test_collocations_against_brute_force(spark, monkeypatch):
    rows = PROSE * 3
    df = spark.createDataFrame([(k, g, t, "clash", "clash", "clash") for k, (g, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n string, f string").repartition(3)
    want = phrases(rows, 6, 5, 2000)
    assert len(want) > 5 and {w[0] for w in want} == {"en", "de", "und"}
    assert mined(df, least=6) == want
    assert mined(df, least=2, longest=3, top=3) == phrases(rows, 2, 3, 3)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 2)  # the same through shuffles
    assert mined(df, least=6) == want


def test_written_blocks_are_few_in_a_row_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodscape.sources.scratch.new_folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 1 << 17)
    words = F.expr("transform(sequence(1, 60000), k -> hex(xxhash64(id, k)))")
    docs = spark.range(0, 90, 1, 1).select(F.lit("en").alias("lang"), F.concat_ws(" ", words).alias("text"))
    collocations.frequent_phrases(docs, 100, 2)
    (file,) = (tmp_path / "word-lists").glob("*.parquet")
    groups = [pq.ParquetFile(file).metadata.row_group(k) for k in range(pq.ParquetFile(file).num_row_groups)]
    assert sum(g.num_rows for g in groups) == 30 and max(g.total_byte_size for g in groups) < 32 << 20


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert mined(empty) == []
    assert mined(spark.createDataFrame([(None, None), ("", "en"), ("a b", "en")], "text string, lang string"), least=2) == []


def test_long_texts_are_split_into_words_part_by_part(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 7)
    text = "One two,three  four\tfive. a-very-long-word-beyond-the-slice x y\nz" * 5
    whole = text.translate(LOWER)
    want = [p for p in re.findall(r"[^\s.,;:!?]+|[.,;:!?\n]", whole)]
    got = [w.decode() for part in collocations.words_and_ends(text.encode()) for w in part]
    assert got == ["." if w in ".,;:!?\n" else w for w in want]


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**11
    phrase_rows = [(0, "en", 1, "a", "a", 5 * big), (1, "en", 1, "b", "b", 3 * big), (2, "en", 2, "a b", "b", 2 * big)]
    given = spark.createDataFrame(phrase_rows, "id long, lang string, words int, phrase string, last string, f long"), spark.createDataFrame([("en", 7 * 10**13)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: given)
    assert mined(spark.range(0).select(F.lit("").alias("text"), F.lit("").alias("lang"))) == [("en", 1, "a b", 2 * big, 5 * big, 3 * big, 7 * 10**13, 1000 * 2 * big * 7 * 10**13 // (15 * big * big))]


# --- 12: alignment -----------------------------------------------------------------------------

A_PATH, B_PATH = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", " ", "  ", "a", "\n", "a b", " a  b   c", "a\n b\n\n  c", "tabs\tand blanks　here", "Grüße aus Köln, 100 km!", "日本語のテキスト 🙂🙂 x", "no▁pieces ▁ here", "don't we'll 'tis ''s",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "日" * 500, "\0 \x1c a\x1fb \x85 c", "ﬁ ligature é é", "a   b\r\nc", "same text here", "same text here", "1234567890 3.14159", " \n a", "a " * 300,
]


def whole_alignment(text, a_tok, a_bytes, b_model):
    """(A ids, B ids, groups, links) by whole texts and sets of ends."""
    full = (" " + (text or "")).encode()
    a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
    b = b_model.encode(text) if text else []
    spell_b = lambda t: bytes([int(b_model.id_to_piece(t)[3:5], 16)]) if b_model.is_byte(t) else b_model.id_to_piece(t).replace("▁", " ").encode()
    x, y = [a_bytes[t] for t in a], [spell_b(t) for t in b]
    if b"".join(x) != full or b"".join(y) != full:
        return [], [], [], []
    ends = lambda parts: list(itertools.accumulate(map(len, parts)))
    ea, eb = ends(x), ends(y)
    links = [(a[ea.index(e)], b[eb.index(e)]) for e in eb if e in set(ea)]
    groups, low = [], 0
    for e in sorted(set(ea) & set(eb)):
        groups.append(([t for t, k in zip(a, ea) if low < k <= e], [t for t, k in zip(b, eb) if low < k <= e]))
        low = e
    return a, b, groups, links


def brute_force_alignment(texts):
    a_tok = tokenizers.Tokenizer.from_file(A_PATH)
    a_tok.encode_special_tokens = True
    of = alignment.byte_characters()
    a_bytes = {k: bytes(of[c] for c in t) for t, k in a_tok.get_vocab().items() if all(c in of for c in t)}
    b_model = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    each = [whole_alignment(t, a_tok, a_bytes, b_model) for t in texts]
    count = Counter(link for *_, links in each for link in links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for a, b, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((len(a), len(b), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), sha))
    return out


def test_alignment_against_brute_force(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 500)
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, "no id", "clash", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, links string, groups string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in queries.op12_alignment(spark, str(tmp_path)).collect()}
    want = brute_force_alignment([*texts, "no id"])
    assert len(got) == len(rows)
    for (k, text, *_), w in zip(rows, want):
        assert got[k] == w, text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab A'.,\n\t 　▁é日🙂1s \0\x1c")), max_size=60), st.integers(1, 9))
def test_parts_have_the_tokens_of_the_whole(text, size):
    aligner, cut = alignment._aligner(A_PATH, B_PATH), alignment.parts(" " + text, size)
    assert "".join(cut) == " " + text
    if text:
        assert [t for p in aligner.encode_a(cut) for t in p] == list(aligner.encode_a([" " + text])[0])
        assert [t for p in aligner.encode_b([p[1:] for p in cut]) for t in p] == aligner.encode_b([text])[0]


def test_alignment_of_long_and_no_texts(spark, monkeypatch):
    aligner = alignment._aligner(A_PATH, B_PATH)
    texts = [None, "", " ".join(f"word{i % 7}{'x' * (i % 3)}" for i in range(300)), "▁", "y" * 50_000 + " z " * 9, "end"]
    once = aligner.texts(texts)
    assert once == [aligner.texts([t])[0] for t in texts] and once[0] == once[1] == once[3] == (0, 0, 0, "", b"")
    monkeypatch.setattr(alignment, "PART", 10)
    assert aligner.texts(texts) == once
    empty = spark.createDataFrame([], "doc_id long, text string")
    blocks = alignment.link_blocks(alignment.align_texts(empty, A_PATH, B_PATH).drop("text"))
    assert alignment.link_scores(blocks, alignment.link_counts(blocks)).count() == 0
    none = alignment.align_texts(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_PATH, B_PATH).drop("text")
    blocks = alignment.link_blocks(none)
    assert sorted(tuple(r) for r in alignment.link_scores(blocks, alignment.link_counts(blocks)).select("doc_id", "n_links", "n_best", "count_sum").collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]


# --- 13: license scans -------------------------------------------------------------------------

MIT = licenses.TEMPLATES[0][1]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = sorted((label, i) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
    return words, found


def slow_notices(words):
    """Labels and scores of templates by comparing all positions, diagonal by diagonal."""
    out = set()
    for label, notice in licenses.TEMPLATES:
        t, k = base_places(notice)[0], licenses.RUN
        equal = {(i, j) for i in range(len(words) - k + 1) for j in range(len(t) - k + 1) if words[i : i + k] == t[j : j + k]}
        place: list = []
        for d in sorted({i - j for i, j in equal}):
            if not place or d - place[-1][-1] > max(1, min(8, len(t) // 8)):
                place.append([])
            place[-1].append(d)
        for ds in place:
            held = {(i, j) for i, j in equal if i - j in ds}
            covered = {j + x for _, j in held for x in range(k)}
            start, end = min(i for i, _ in held), max(i for i, _ in held) + k
            if len(covered) / len(t) >= licenses.LEAST_SHARE and end - start <= licenses.MOST_LONG * len(t):
                out.add((label, start, end, round(len(covered) / len(t), 9)))
    return out


def test_licenses_against_brute_force(spark, sf):
    words = MIT.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 40 != 7)
    texts = [
        None, "", "MIT", "mit license", "The MIT-License and mit LICENSE mit license", "General Public\nLicense general public general public license", "apache 2.0 license",
        MIT, "prose before " * 30 + MIT + " prose after" * 30, changed, " ".join(words[:60]), "\n".join(n for _, n in licenses.TEMPLATES), MIT.upper() + MIT,
        "Licensed under CC BY-NC 4.0. " * 50, "licensed under cc by", "über mit license naïve", "permission is hereby granted free " * 20, "Licensed under the Apache License, Version 2.0.",
    ]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    rows = [(k, t, "clash", "clash", "clash") for k, t in enumerate(texts)] + [(0, "mit license", "clash", "clash", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, notices string, row string, pos string")
    scanned = licenses.scan_licenses(df).cache()
    digest = {(r["doc_id"], r["n_words"]): r for r in licenses.license_digest(scanned).collect()}
    full = {(r["doc_id"], r["n_words"]): r for r in scanned.collect()}
    assert len(full) == len(rows) == len(digest) and set(scanned.columns) == {"doc_id", "row", "pos", "n_words", "phrases", "notices"}
    for k, t, *_ in rows:
        w, found = base_places(t)
        r, d = full[k, len(w)], digest[k, len(w)]
        notices = slow_notices(w)
        assert [tuple(p) for p in r["phrases"]] == found
        assert {(n["label"], n["start"], n["end"], round(n["score"], 9)) for n in r["notices"]} == notices, t
        starts = [s for _, s in found]
        assert (d["n_base"], d["first_word"], d["last_word"]) == (len(found), min(starts, default=None), max(starts, default=None))
        assert d["base_labels"] == ",".join(sorted({g for g, _ in found})) and d["labels"] == ",".join(sorted({g for g, _ in found} | {n[0] for n in notices}))
        assert d["score"] == pytest.approx(1.0 if found else max((n[3] for n in notices), default=0.0))
    assert digest[7, len(base_places(MIT)[0])]["labels"] == "mit" and digest[9, len(base_places(changed)[0])]["labels"] == "mit"


def test_licenses_by_a_shuffle_and_of_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(1, MIT), (2, "no license"), (3, None)], "doc_id long, text string")
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 2)
    assert sorted((r["doc_id"], r["labels"]) for r in licenses.license_digest(licenses.scan_licenses(df)).collect()) == [(1, "mit"), (2, ""), (3, "")]
    assert licenses.license_digest(licenses.scan_licenses(df.limit(0))).count() == 0
    assert sorted(r["n_words"] for r in licenses.scan_licenses(df, templates=[], phrases=[]).collect())[0] == 0
    long = spark.createDataFrame([("a " * 400_000 + "mit license",)], "text string")
    assert licenses.scan_licenses(long).select("n_words", "phrases").first()["phrases"][0]["start"] == 400_000
