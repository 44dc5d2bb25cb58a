"""Operators that compare documents, the classifier and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodscape.llm import components, packing, pii, quality, queries, simhash, substrings
from lodscape.llm.components import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def sentence(r, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my ny xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()):
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


# --- components --------------------------------------------------------------------------------


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    nodes = {n for e in links for n in e if e[0] != e[1]}
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links + [(None, 1)], "u long, v long")).collect()}
    assert got == roots(nodes, [e for e in links if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [200_000, 1])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(components, "EDGES_A_TASK", few)
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    nodes = {x for link in links if link[0] != link[1] for x in link}
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == roots(nodes, [(u, v) for u, v in links if u != v])


def test_simhash_broadcasts_nothing_uncounted(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(k, f"text number {k // 2} of some", None, None, 0) for k in range(40)], DOC)
    classes = simhash.simhash_classes(docs)
    assert classes.count() == 40 and len({x["component_id"] for x in classes.collect()}) == 20
    assert "BroadcastHashJoin" not in classes._jdf.queryExecution().executedPlan().toString()


# --- 4: simhash --------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [1024, 3])
def test_simhash_classes(spark, bucket):
    r = random.Random(9)
    base = [sentence(r, 60) for _ in range(12)]
    texts = [None, "", " \n", "one", "one two", "ÀB c D"] + base + [b.replace(" ", "  ", 3) for b in base] + [b.upper() for b in base[:4]]
    for b in base:
        words = b.split()
        for _ in range(6):
            w = list(words)
            w[r.randrange(len(w))] = "edit" + str(r.randrange(3))
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOC)
    prints = [slow_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    want = roots(range(len(texts)), links)
    rows = simhash.simhash_classes(docs, bucket=bucket).collect()
    assert {x["doc_id"]: x["component_id"] for x in rows} == want
    assert {x["doc_id"]: x["fp"] % (1 << 64) for x in rows} == dict(enumerate(prints))
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()}
    assert kept == set(want.values())


def test_simhash_of_long_texts_and_any_names(spark):
    texts = ["日本語 " * 70_000, "word " * 70_000, "x" * 300_000, None]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, _lodscape_id int, fp int")
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.simhash_classes(docs).collect()} == {k: slow_fingerprint(t) for k, t in enumerate(texts)}
    assert simhash.drop_near_duplicates(docs).columns == simhash.drop_similar_documents(docs).columns == docs.columns


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d", None, None, 0), (1, "a b c d", None, None, 0), (None, "a b c d", None, None, 0), (2, "A b c d", None, None, 0)], DOC)
    rows = sorted((x["doc_id"] or 0, x["component_id"]) for x in simhash.simhash_classes(docs).collect())
    assert rows == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert sorted(x["doc_id"] or 0 for x in simhash.drop_near_duplicates(docs).collect()) == [0, 1, 1]
    assert simhash.simhash_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [24, 3])
def test_near_copies_of_the_pipeline_stage(spark, monkeypatch, bucket):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    r = random.Random(77)
    base = [sentence(r, 150) for _ in range(30)]
    texts = [None, "", " \n", "one two", "ONE  two", "one three"] + base
    for k, b in enumerate(base):  # 1 to 6 edits: similarities on both sides of 0.8
        for edits in (1, 2, 3, 4, 6):
            w = b.split()
            for e in range(edits):
                w[10 + e * 22] = f"edit{k}-{edits}-{e}"
            texts.append(" ".join(w).upper() if k % 5 == 0 else "\n".join(w))
    sets = [shingle_set((t or "").lower().split()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bits = [bin(slow_fingerprint(texts[a]) ^ slow_fingerprint(texts[b])).count("1") for a, b in links]
    assert sum(x > 2 for x in bits) > 50
    want = set(roots(range(len(texts)), links).values())
    assert 30 + 30 <= len(want) < len(texts) - 60
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)] + [(None, base[0], None, None, 0)], DOC)
    kept = [x["doc_id"] for x in pipeline.drop_near_copies(spark, docs, None).collect()]
    assert None in kept and set(kept) - {None} == want


def test_the_pipeline_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(substrings, "similar_paragraphs", lambda docs, distinct, words, sure: sure.limit(0))  # nothing by bands
    r = random.Random(78)
    base = [sentence(r, 400) for _ in range(20)]
    texts = base + [b + f" more{k}" for k, b in enumerate(base)]
    prints = [simhash.fingerprint_of(t, words=5) for t in texts]
    assert all(len(shingle_set(b.split())) > 380 for b in base) and len(set(prints)) > 20
    hashes = [substrings.shingles_of(substrings.hashed_words(t.encode().split())) for t in texts]
    near = sum(bin((simhash.majority_bits(a) ^ simhash.majority_bits(b)) % (1 << 64)).count("1") <= 2 for a, b in zip(hashes, hashes[20:]))
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], DOC)
    kept = pipeline.drop_near_copies(spark, docs, None).count()
    assert near >= 15 and kept == 40 - near


# --- 3: substrings -----------------------------------------------------------------------------


def shingle_set(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected_cuts(texts):
    """Words that must go: near-equal paragraphs by component, and windows of 50 words that an earlier document has."""
    lines, gone = [], {k: set() for k in texts}
    for k, t in texts.items():
        at = 0
        for line in (t or "").split("\n"):
            w = line.split()
            if len(w) >= 50:
                lines.append((k, at, w))
            at += len(w)
    sets = [shingle_set(w) for *_, w in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(range(len(lines)), links)
    for n, (k, at, w) in enumerate(lines):
        if k != min(lines[m][0] for m in root if root[m] == root[n]):
            gone[k].update(range(at, at + len(w)))
    first = {}
    for k in sorted(texts):
        w = (texts[k] or "").split()
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    for k, t in texts.items():
        w = (t or "").split()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < k:
                gone[k].update(range(i, i + 50))
    return gone


@pytest.fixture(scope="module")
def shared_passages():
    r = random.Random(12)
    passage, common, clean = sentence(r, 55), sentence(r, 70), [sentence(r, 80) for _ in range(12)]
    texts = {k: c for k, c in enumerate(clean)}
    texts |= {20: clean[0] + "\n" + passage, 21: sentence(r, 9) + " " + passage + " " + sentence(r, 7), 22: f"{sentence(r, 30)}\n{passage}\n{sentence(r, 30)}", 23: passage, 24: None, 25: "", 26: sentence(r, 49), 27: "\n\n"}
    texts |= {28: texts[26], 29: texts[22], 30: texts[22]}
    near = clean[3].split()
    near[40] = "changed"
    texts[31] = "intro line\n" + " ".join(near)
    texts |= {40 + k: sentence(r, 20) + "\n" + common + "\n" + sentence(r, 20) for k in range(40)}
    for k in range(40):  # copies of one paragraph with an edit each
        w = common.split()
        w[r.randrange(70)] = f"edit{k}"
        texts[100 + k] = " ".join(w)
    return texts


def test_cut_repeats(spark, shared_passages):
    texts = shared_passages
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOC).withColumns({c: F.lit("clash") for c in ("repeats_of", "_id", "_text", "_spans", "key")})
    got = {x["doc_id"]: x for x in substrings.cut_repeats(docs).collect()}
    assert set(got) == set(texts)
    gone = expected_cuts(texts)
    for k, t in texts.items():
        words = (t or "").split()
        assert (got[k]["text"] or "").split() == [w for i, w in enumerate(words) if i not in gone[k]], k
        assert got[k]["n_cut_words"] == len(gone[k])
        assert bool(got[k]["repeats_of"]) == bool(gone[k]) and all(s < k for s in got[k]["repeats_of"])
    assert got[24]["text"] is None and got[0]["text"] == texts[0] and got[31]["text"] == "intro line"


def cut_counts(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOC)
    return {x["doc_id"]: x["n_cut_words"] for x in substrings.cut_repeats(docs).collect()}


def test_passages_whose_parts_stand_in_other_documents_too(spark):
    r = random.Random(31)
    texts, passages = {}, []
    for k in range(40):
        words = sentence(r, 50 + k % 13).split()
        passages.append(" ".join(words))
        # parts of the passage in still earlier documents, one of them in the middle of other words
        texts[3 * k] = f"{sentence(r, 12)} {' '.join(words[:30])} {sentence(r, 9)}\n{sentence(r, 5)} {' '.join(words[-30:])}"
        texts[3 * k + 1] = f"{sentence(r, 8)} {' '.join(words[10:45])} {sentence(r, 4)} {' '.join(words[5:20])}"
        texts[3 * k + 2] = f"{sentence(r, 20)} {passages[-1]} {sentence(r, 20)}"
        texts[500 + k] = f"{sentence(r, 7)} {passages[-1]} {sentence(r, 3)}"
    texts[600] = "same " * 120
    texts[601] = sentence(r, 5) + " " + "same " * 90
    gone = expected_cuts(texts)
    assert all(len(gone[500 + k]) >= 50 + k % 13 for k in range(40))
    assert cut_counts(spark, texts) == {k: len(g) for k, g in gone.items()}


def test_chains_of_common_phrases_stay(spark):
    r = random.Random(41)
    words = sentence(r, 130).split()
    texts = {k: f"{sentence(r, 10)} {' '.join(words[20 * k : 20 * k + 40])} {sentence(r, 10)}" for k in range(6)}  # each overlaps the next
    texts[100] = " ".join(words)
    texts[101] = " ".join(words[30:100])
    gone = expected_cuts(texts)
    assert not gone[100] and len(gone[101]) == 70
    assert cut_counts(spark, texts) == {k: len(g) for k, g in gone.items()}


def test_any_fifty_words_share_an_anchor():
    r = np.random.default_rng(8)
    for _ in range(300):
        shared, n = r.integers(0, 1 << 63, 50, dtype=np.uint64), r.integers(0, 90, 4)
        if r.random() < 0.3:
            shared[:] = shared[np.arange(50) % r.integers(1, 5)]
        x, y = (np.concatenate([r.integers(0, 1 << 63, a, dtype=np.uint64), shared, r.integers(0, 1 << 63, b, dtype=np.uint64)]) for a, b in (n[:2], n[2:]))
        own = [{(int(at - begin), int(key)) for at, key in zip(*substrings.anchors_of(h)) if begin <= at <= begin + 24} for h, begin in ((x, n[0]), (y, n[2]))]
        assert own[0] & own[1]


def test_crowded_buckets_lose_no_link(spark, shared_passages, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET", 3)
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in shared_passages.items()], DOC)
    gone = expected_cuts(shared_passages)
    assert {x["doc_id"]: x["n_cut_words"] for x in substrings.cut_repeats(docs).collect()} == {k: len(g) for k, g in gone.items()}


def test_prefixes_meet():
    r = random.Random(5)
    for _ in range(800):
        n = r.randint(1, 150)
        x, y = set(range(n)), set(range(n))
        for _ in range(r.randint(0, max(1, n // 6))):
            s = r.choice((x, y))
            s.discard(r.randrange(n)) if r.random() < 0.5 and len(s) > 1 else s.add(1000 + r.randrange(5000))
        if len(x & y) >= 0.8 * len(x | y):
            order = lambda t: (t * 7919 % 1009, t)
            other = set(substrings._prefixes(sorted(y, key=order)))
            assert any((t, a, b, not small) in other for t, a, b, small in substrings._prefixes(sorted(x, key=order)))


def test_parities_differ_in_no_more_bits_than_sets():
    r = np.random.default_rng(5)
    for n in (1, 4, 83, 700):
        x = r.integers(-(1 << 63), 1 << 63, n)
        for changed in (0, 1, n // 3, n):
            y = np.concatenate([x[changed:], r.integers(-(1 << 63), 1 << 63, changed + 2)])
            apart = sum(int(a ^ b).bit_count() if a ^ b >= 0 else 64 - int(~(a ^ b)).bit_count() for a, b in zip(substrings._parities(x).tolist(), substrings._parities(y).tolist()))
            assert apart <= len(np.setxor1d(x, y)) and (changed or apart in (0, 2))


def test_variants_of_a_template_lose_no_link_and_make_few_candidates(spark):
    r = random.Random(8)
    template = [f"w{i}" for i in range(87)]
    texts = {}
    for i in range(240):
        words = list(template)
        for place in r.sample(range(87), r.choice((1, 2, 3))):
            words[place] = f"v{i}x{place}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in texts.items()], "doc_id long, raw binary")
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in texts.items()}
    links = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    nodes = spark.createDataFrame([(i, i) for i in texts], "key long, part long")
    distinct = spark.createDataFrame([(i, i, 0, 87) for i in texts], "key long, first long, at long, n long")
    found = {(p["u"], p["v"]) for p in substrings._crowded_pairs(docs, distinct, nodes, bytes.split).collect()}
    assert links <= found and len(found) < 2 * len(links) < len(texts) * (len(texts) - 1) / 2


def test_no_word_is_lost_altogether(spark):
    r = random.Random(77)
    base = sentence(r, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    texts = {1: " ".join(base), 2: " ".join(near), 3: f"{sentence(r, 20)} {' '.join(near[20:100])} {sentence(r, 20)}", 4: f"{sentence(r, 30)} {' '.join(near[20:100])}"}
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], DOC)
    got = {x["doc_id"]: x for x in substrings.cut_repeats(docs).collect()}
    assert got[1]["text"] == texts[1] and got[2]["text"] == "" and got[2]["repeats_of"] == [1]
    assert got[3]["text"] == texts[3] and got[4]["repeats_of"] == [3] and got[4]["n_cut_words"] == 80
    # each run that is cut as equal stands in a text that a named document keeps
    kept = {k: x["text"].split() for k, x in got.items()}
    for k in (3, 4):
        words = texts[k].split()
        for i in range(len(words) - 49):
            if not any(words[i : i + 50] == kept[k][j : j + 50] for j in range(len(kept[k]) - 49)):
                cut = [w for w in words[i : i + 50]]
                assert any(w in kept[s] for s in [k, *got[k]["repeats_of"]] for w in cut)
    assert "changed" in kept[3]


def test_cut_words():
    cut = substrings.cut_words
    assert cut("a b c\nd e\n\nf", [(1, 1)]) == "a c\nd e\n\nf"
    assert cut("a b c\nd e\n\nf", [(0, 3)]) == "d e\n\nf"
    assert cut("a b c\nd e\n\nf", [(2, 2)]) == "a b\ne\n\nf"
    assert cut("a b", [(0, 2)]) == "" and cut("a  b", []) == "a  b"


def test_cut_repeats_odd_rows(spark, shared_passages):
    passage = shared_passages[23]
    docs = spark.createDataFrame([(1, passage, "en", "s", 0), (1, passage, "en", "s", 0), (None, passage, "en", "s", 0), (2, passage, "en", "s", 0)], DOC)
    got = sorted((x["doc_id"] or 0, x["n_cut_words"]) for x in substrings.cut_repeats(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 55)]
    assert substrings.cut_repeats(docs.limit(0)).count() == 0


# --- 6: classifier -----------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 50 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)


def test_classifier_gradient_and_attention():
    r = np.random.default_rng(0)
    good = [r.normal(0, 1, (r.integers(1, 5), quality.FEATURES)) for _ in range(60)]
    bad = [np.concatenate([g, r.normal(0, 1, (1, quality.FEATURES)) + 3]) for g in good]  # one odd passage makes the document bad
    model = quality.fit(good + bad, np.array([1] * 60 + [0] * 60), steps=400)
    s = model.score(good + bad)
    assert s[:60].mean() > 0.9 and s[60:].mean() < 0.1
    f = model.forward(np.concatenate(bad), np.cumsum([0, *map(len, bad[:-1])]))
    ends = np.cumsum([len(b) for b in bad]) - 1
    many = np.array([len(b) > 1 for b in bad])
    assert f["a"][ends][many].mean() > 0.5


def test_forward_pass_is_the_formula():
    r = np.random.default_rng(3)
    docs = [r.normal(0, 1, (n, quality.FEATURES)) for n in (1, 3, 7)]
    model = quality.fit(docs * 4, np.array([0, 1, 1] * 4), steps=5)
    p, sigmoid = model.weights, lambda v: 1 / (1 + np.exp(-v))
    for x, got in zip(docs, model.score(docs)):
        z = [np.tanh(((row - model.mean) / model.scale) @ p["W"] + p["b"]) for row in x]
        e = [float(sum(np.tanh(v @ p["V"])[k] * sigmoid(v @ p["U"])[k] * p["w"][k] for k in range(len(p["w"])))) for v in z]
        a = [np.exp(v) / sum(np.exp(w) for w in e) for v in e]
        assert abs(got - sigmoid(sum(w * v for w, v in zip(a, z)) @ p["c"] + p["d"])) < 1e-9


def test_attention_finds_the_bad_passage_of_a_text(spark):
    """Documents of the corpus with one passage of a rejected document put among theirs."""
    sf = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "text", "quality").collect()}
    rows = {k: quality.encode_document(x["text"]) for k, x in texts.items()}
    held = {k for k in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    learned = sorted(rows.keys() - held)
    model = quality.fit([quality.pooled(rows[k]) for k in learned], np.array([texts[k]["quality"] for k in learned]))
    good, bad = ([rows[k] for k in sorted(held) if texts[k]["quality"] == q] for q in (1, 0))
    r, mixed, places = np.random.default_rng(5), [], []
    for g in [g for g in good if len(g) >= 4][:100]:
        places.append(r.integers(len(g) + 1))
        mixed.append(np.insert(g, places[-1], bad[r.integers(len(bad))][0], axis=0))
    starts = np.cumsum([0, *map(len, mixed[:-1])])
    f = model.forward(np.concatenate(mixed).astype(np.float64), starts)
    assert np.median(f["a"][starts + np.array(places)]) > 0.5 > 2 * np.median([1 / len(m) for m in mixed])
    uniform = quality.PassageModel(model.mean, model.scale, model.weights | {"w": 0 * model.weights["w"]})
    assert (f["score"] < 0.3).mean() > 0.9 > 0.5 > (uniform.score(mixed) < 0.3).mean()
    assert (model.score(good) >= 0.3).mean() > 0.99


def test_long_documents_are_learned_from_bounded_rows():
    x = np.arange(1000 * quality.FEATURES, dtype=np.float32).reshape(1000, -1)
    p, edges = quality.pooled(x), [1000 * k // quality.SAMPLE_PASSAGES for k in range(quality.SAMPLE_PASSAGES)] + [1000]
    assert np.allclose(p, [x[a:b].mean(axis=0) for a, b in zip(edges, edges[1:])]) and len(quality.pooled(x[:5])) == 5


def test_rows_that_repeat_an_id_are_learned_from_once(spark):
    docs = spark.createDataFrame([(k % 6, f"{'good words here ' * 9 if k % 2 else '### $$$ %%% '} {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    models = [quality.learn_quality(docs.repartition(n), labels) for n in (1, 5)]
    assert all(np.array_equal(models[0].weights[k], models[1].weights[k]) for k in models[0].weights)


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (None, "x", None, None, 0), (3, "y " * 20_000, None, None, 0), (3, "y " * 20_000, None, None, 0)], DOC).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn_quality(docs, none) is None
    assert {r["score"] for r in quality.score_quality(docs, None).collect()} == {0.5}
    conflict = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.learn_quality(docs, conflict) is None
    model = quality.fit([quality.encode_document(t) for t in ("a clean text here", "### $$$ %%% &&&") * 4], np.array([1, 0] * 4), steps=50)
    out = quality.score_quality(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"] and out.count() == 5
    assert quality.score_quality(docs.limit(0), model).count() == 0


# --- the pipeline ------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_quality_classifier(spark, sf).collect()}
    texts = {k: t for k, t in texts.items() if scores[k]}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {k: shingle_set(re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))) for k, t in texts.items()}
    root = roots(texts, [(a, b) for a in texts for b in texts if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    texts = {k: t for k, t in texts.items() if root[k] == k}
    for k, gone in expected_cuts(texts).items():
        spans = [(i, 1) for i in sorted(gone)]
        texts[k] = substrings.cut_words(texts[k], spans) if spans else texts[k]
    masked = pii.mask_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    encode = packing.word_encoder(queries.public_vocabulary("word_bpe_49k.json"))
    want = {r["doc_id"]: encode(r["text"].encode()) + bytes(4) for r in masked.collect()}
    got, fills = {}, {}
    for r in pipeline.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], bytes(r["ids"])))
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert {k: b"".join(p for _, p in sorted(v)) for k, v in got.items()} == want
    assert max(fills.values()) <= 2048 and len(fills) <= -(-sum(len(v) // 4 for v in want.values()) // 2048) + 1
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5


def test_stages_pass_few_texts_at_once(spark, tmp_path, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from lodscape.llm.common import texts_at_once

    def counted(spark, docs, sf_dir):
        return docs.select("doc_id").mapInArrow(lambda batches: (b for b in batches if b.num_rows > 512), "doc_id long")

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [spark.conf.get(k) for k in names]
    spark.range(3000).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipeline, "STAGES", [("large batches", counted)])
    assert pipeline.run(spark, str(tmp_path)).count() == 0 and [spark.conf.get(k) for k in names] == before
    with pytest.raises(RuntimeError), texts_at_once(spark):
        raise RuntimeError
    assert [spark.conf.get(k) for k in names] == before


def test_every_stage_keeps_the_columns(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes
