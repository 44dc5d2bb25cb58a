"""Substring dedup: passages that earlier documents hold too are cut out of later ones."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, give_back, let_go, written
from .components import connected_components

#: Words of a shingle, least similarity of two paragraphs, and least words of a passage or paragraph that is cut.
SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 50
#: 14 bands of 4 rows: a pair at similarity 0.8 shares a band with probability 0.9994, one at 0.2 with 0.02.
BANDS, ROWS = 14, 4
#: Words of a gram, and of how many neighbouring grams the one with the least hash is an anchor: any 50 words hold one.
GRAM = 26
REACH = LEAST_WORDS - GRAM + 1
#: Up to so many paragraphs in a band's bucket are compared with each other; beyond it see :func:`similar_paragraphs`.
BUCKET = 24
#: Shingles are counted by so many leading bits of their hash: 262,144 counters (2 MB) at any size of the input.
COUNTER_BITS = 18
#: Longs of a set's parity bits: what two sets have in common cancels out in them.
PARITY_LONGS = 8

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@functools.lru_cache(maxsize=2)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(2024)
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """A hash for each run of five words; a shorter paragraph is one shingle."""
    n = len(hashes) - SHINGLE + 1
    width = SHINGLE if n > 0 else len(hashes)
    h = np.zeros(max(n, 1), dtype=np.uint64)
    for k in range(width):
        h = _mixed(h * _MULTIPLIER + hashes[k : k + len(h)])
    return h


def bands_of(shingles: np.ndarray, starts: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A row of band hashes for each paragraph; ``starts``: where its shingles begin."""
    a, b = _permutations(bands * ROWS)
    rows = np.empty((len(a), len(starts)), dtype=np.uint64)
    for k in range(len(a)):
        rows[k] = np.minimum.reduceat((shingles * a[k] + b[k]) >> np.uint64(20), starts)
    rows = rows.reshape(bands, ROWS, -1)
    h = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(starts), axis=1)
    for k in range(ROWS):
        h = _mixed(h * _MULTIPLIER + rows[:, k])
    return np.ascontiguousarray(h.T).view(np.int64)


def _runs_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of so many words."""
    h, width, done = hashes, 1, np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    at = 0
    while len(done):
        if words & width:
            done = _mixed(done * _MULTIPLIER + h[at : at + len(done)] + np.uint64(width))
            at += width
        if 2 * width > words:
            break
        h = _mixed(h[:-width] * _MULTIPLIER + h[width:])
        width *= 2
    return done


def anchors_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of a document's anchors: of each REACH neighbouring grams the one with the least hash, the
    last of equal ones. Which they are depends on the words alone, so equal runs of 50 words share an anchor."""
    grams = _runs_of(hashes, GRAM)
    if len(grams) < REACH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    found = [np.zeros(0, dtype=np.int64)]
    for k in range(0, len(grams) - REACH + 1, 1 << 16):
        near = np.lib.stride_tricks.sliding_window_view(grams[k : k + (1 << 16) + REACH - 1], REACH)
        found.append(np.arange(k, k + len(near)) + REACH - 1 - np.argmin(near[:, ::-1], axis=1))
    at = np.unique(np.concatenate(found))
    return at, grams[at].view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of 50 words that hold one of a document's given anchors."""
    for part in _few(batches, 32):
        owners, places, keys = [], [], []
        for owner, raw, anchors in zip(*(part.column(c).to_pylist() for c in range(3))):
            every = _runs_of(hashed_words((raw or b"").split()), LEAST_WORDS)
            first = np.array(anchors, dtype=np.int64)
            change = np.zeros(len(every) + 1, dtype=np.int64)
            np.add.at(change, np.minimum(np.maximum(first - REACH + 1, 0), len(every)), 1)
            np.add.at(change, np.minimum(first + 1, len(every)), -1)
            at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
            owners.append(np.full(len(at), owner, dtype=np.int64))
            places.append(at)
            keys.append(every[at].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (owners, places, keys)], names=["doc_id", "at", "key"])


def _lists(counts: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at a time that a worker holds little of them as Python objects, nor what other operators keep."""
    let_go()
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.slice(i, rows)
    give_back()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _few(batches):
        words: list[bytes] = []
        sizes, line_counts, line_at, line_n, keys, line_first = [], [], [], [], [], []
        for raw in part.column(1).to_pylist():
            begin, n_lines = len(words), 0
            for line in (raw or b"").split(b"\n"):
                own = line.split()
                if len(own) >= LEAST_WORDS:
                    n_lines += 1
                    line_first.append(len(words))
                    line_at.append(len(words) - begin)
                    line_n.append(len(own))
                    keys.append(xxhash.xxh3_128_digest(b" ".join(own)))
                words += own
            sizes.append(len(words) - begin)
            line_counts.append(n_lines)
        h = hashed_words(words)
        bands = np.zeros((0, BANDS), dtype=np.int64)
        if line_first:
            every = shingles_of(h)
            n = np.array(line_n) - SHINGLE + 1
            starts = np.cumsum(n) - n
            bands = bands_of(every[np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(line_first, n)], starts)
        banded = _lists(np.full(len(bands), BANDS), pa.array(bands.reshape(-1)))
        lines = pa.StructArray.from_arrays([pa.array(line_at, pa.int64()), pa.array(line_n, pa.int64()), pa.array(keys, pa.binary()), banded], names=["at", "n", "key", "bands"])
        ends = np.cumsum(sizes)
        found = [anchors_of(h[end - size : end]) for end, size in zip(ends, sizes)]
        start, key = (np.concatenate([f[k] for f in found]) for k in range(2))
        anchors = pa.StructArray.from_arrays([pa.array(start), pa.array(key)], names=["at", "key"])
        texts = pa.array([xxhash.xxh3_128_digest(raw or b"") for raw in part.column(1).to_pylist()], pa.binary())
        columns = [part.column(0), texts, pa.array(sizes, pa.int64()), _lists(line_counts, lines), _lists([len(at) for at, _ in found], anchors)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "words", "lines", "anchors"])


def small(df: DataFrame, entries: str | None = None) -> DataFrame:
    """A written table, marked for broadcast if it was counted to be small (its rows, or the entries of an array column);
    larger ones are joined by a shuffle, whatever Spark guesses of their size."""
    held = df.agg(F.sum(F.size(entries)) if entries else F.count("*")).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_ROWS else df.hint("merge")


def _looked_up(docs: DataFrame, wanted: DataFrame, name: str, find: Callable[[np.ndarray, dict], list[int]], words: Callable[[bytes], list[bytes]] = bytes.split) -> DataFrame:
    """``(id, found)`` for rows ``(doc_id, id, at, n)`` of ``wanted``, found in the words of their documents."""
    kind = wanted.schema["id"].dataType.simpleString()
    per_doc = written(wanted.groupBy("doc_id").agg(F.collect_set(F.struct("id", "at", "n")).alias("items")), f"{name}-wanted")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            ids, found = [], []
            for raw, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = hashed_words(words(raw or b""))
                for item in items:
                    ids.append(item["id"])
                    found.append(find(h, item))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(1).type.value_type.field("id").type), pa.array(found, pa.list_(pa.int64()))], names=["id", "found"])

    return written(docs.join(small(per_doc, "items"), "doc_id").select("raw", "items").mapInArrow(look, f"id {kind}, found array<bigint>"), name)


def _paragraph(h: np.ndarray, item: dict) -> list[int]:
    return np.unique(shingles_of(h[item["at"] : item["at"] + item["n"]])).view(np.int64).tolist()


def similar_paragraphs(docs: DataFrame, distinct: DataFrame, words: Callable[[bytes], list[bytes]] = bytes.split, sure: DataFrame | None = None) -> DataFrame:
    """``(u, v)`` links between keys of different paragraphs of which the Jaccard similarity is 0.8 or more.

    ``distinct``: ``(key, first, at, n, bands)``, its keys numbers; ``words`` cuts a text; ``sure``: links found before, a written
    table, within whose components no more are looked for. Paragraphs that share a band are candidates. In
    buckets of up to :data:`BUCKET` all are compared. In larger ones each is compared with one hub, the
    member that lies in most of them; :func:`_crowded_pairs` finds the links that are still missing
    between components, so copies of one paragraph cost a comparison each and no link is lost.
    """
    banded = written(distinct.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket")), "bands")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("key").alias("u"), F.max("key").alias("v")).where("size > 1")
    buckets = written(buckets, "buckets")
    pairs = buckets.where("size = 2").select("u", "v")
    few = banded.join(small(buckets.where(F.col("size").between(3, BUCKET)).select("bucket")), "bucket")
    a, b = few.alias("a"), few.alias("b")
    pairs = pairs.union(a.join(b, F.expr("a.bucket = b.bucket and a.key < b.key")).select(F.col("a.key").alias("u"), F.col("b.key").alias("v")))
    large = buckets.where(F.col("size") > BUCKET).select("bucket")
    crowded = not large.isEmpty()
    if crowded:
        members = written(banded.join(small(large), "bucket"), "members")
        often = members.groupBy("key").agg(F.collect_list("bucket").alias("own"))
        often = often.select("key", F.size("own").alias("often"), F.explode("own").alias("bucket"))
        hubs = often.groupBy("bucket").agg(F.max(F.struct("often", "key")).alias("hub")).select("bucket", F.col("hub.key").alias("hub"))
        pairs = pairs.union(members.join(hubs, "bucket").where("key <> hub").select(F.least("hub", "key").alias("u"), F.greatest("hub", "key").alias("v")))
    if sure is not None:
        parts = connected_components(sure)
        known = lambda end: small(parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")))
        pairs = pairs.distinct().join(known("u"), "u", "left").join(known("v"), "v", "left").where("u_part is null or v_part is null or u_part <> v_part").select("u", "v")
    links = verified_links(docs, distinct, pairs.distinct(), "near", words)
    if not crowded:
        return links
    parts = connected_components(links if sure is None else links.union(sure))
    nodes = members.select("key").distinct().join(parts, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("part"))
    return links.union(verified_links(docs, distinct, _crowded_pairs(docs, distinct, written(nodes, "nodes"), words), "crowded", words))


def _size_class(n: int) -> int:
    return int(math.log(n) / math.log(1.05) + 1e-9)


def _prefixes(tokens: list[int]) -> list[tuple[int, int, int, bool]]:
    """(token, smaller size class, larger one, whether this is the smaller set): what a set of a size shares
    with any set of similarity 0.8 or more. ``tokens`` are in one order for all sets. Sets of sizes a <= b so
    similar have at least 0.8 / 1.8 * (a + b) tokens in common, so the first of these is among the first
    a + 1 less that number of the one, and b + 1 less that number of the other."""
    n, own, out = len(tokens), _size_class(len(tokens)), []
    low, high = math.ceil(SIMILARITY * n - 1e-9), math.floor(n / SIMILARITY + 1e-9)
    for other in range(_size_class(max(low, 1)), _size_class(high) + 1):
        least = math.ceil(1.05**other - 1e-6)
        for smaller, size in ((True, max(least, n)), (False, max(least, low))):
            if (smaller and other < own) or (not smaller and other > own):
                continue
            common = math.ceil(SIMILARITY / (1 + SIMILARITY) * (n + size) - 1e-9)
            pair = (own, other) if smaller else (other, own)
            out += [(t, *pair, smaller) for t in tokens[: max(0, n - common + 1)]]
    return out


def _counter(tokens: np.ndarray) -> np.ndarray:
    """The counter of each shingle."""
    return tokens.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's sets have a shingle of each counter."""
    n = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    for b in batches:
        n += np.bincount(_counter(b.column(0).flatten().to_numpy(zero_copy_only=False)).astype(np.int64), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["counter", "n"])


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles fall on each of 512 bits. Two sets' parities differ in no more bits than
    there are shingles in just one of them."""
    bits = np.bincount((tokens.view(np.uint64) % np.uint64(64 * PARITY_LONGS)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _first_tokens(tokens: np.ndarray, counts: np.ndarray) -> list[int]:
    """The shingles of :func:`_prefixes`, each once and in order, those of the lowest counters first."""
    order = np.lexsort((tokens, counts[_counter(tokens)]))
    return list(dict.fromkeys(t for t, *_ in _prefixes(tokens[order].tolist())))


def _crowded_pairs(docs: DataFrame, distinct: DataFrame, nodes: DataFrame, words: Callable[[bytes], list[bytes]]) -> DataFrame:
    """``(u, v)`` candidates for links between different components among ``nodes`` (``key, part``).

    Shingles are ordered by how few of the nodes have them, the rarest first, as counters tell that shingles of one hash prefix
    share (a table of fixed size; any order is right). A node is listed once for each of its first few (:func:`_prefixes`), with its place.
    Two sets of sizes a and b so similar have at least 0.8 / 1.8 * (a + b) shingles in common, so at the first of these
    at least as many are left in each of them, and at most 0.2 / 1.8 * (a + b) shingles are in just one of them, so that no more
    of their parity bits differ; other pairs are dropped in the join. Of the nodes that have a shingle
    among their first ones, only those that are not in the component that holds most of them are paired with the rest.
    """
    wanted = distinct.join(nodes.select("key"), "key").select(F.col("first").alias("doc_id"), F.col("key").alias("id"), "at", "n")
    sets = _looked_up(docs, wanted, "crowded-shingles", _paragraph, words)
    tally = sets.select("found").mapInArrow(_tallied, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    counts[tally.column("counter").to_numpy()] = tally.column("n").to_numpy()

    parity = [f"parity{i}" for i in range(PARITY_LONGS)]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, 64):
            keys, parts, sizes, tokens, places, parities = [], [], [], [], [], [np.zeros((0, PARITY_LONGS), dtype=np.int64)]
            for key, part, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                own = np.array(t, dtype=np.int64)
                first = _first_tokens(own, counts)
                keys += [key] * len(first)
                parts += [part] * len(first)
                sizes += [len(t)] * len(first)
                tokens += first
                places += range(len(first))
                parities.append(np.tile(_parities(own), (len(first), 1)))
            columns = [pa.array(keys, pa.int64()), pa.array(parts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.int64()), pa.array(places, pa.int32())]
            columns += [pa.array(c) for c in np.concatenate(parities).T]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "n", "token", "at", *parity])

    found = sets.withColumnRenamed("id", "key").join(nodes, "key").select("key", "part", "found")
    found = written(found.mapInArrow(entries, "key bigint, part bigint, n int, token bigint, at int, " + ", ".join(f"{p} bigint" for p in parity)), "prefixes")
    counted = found.groupBy("token", "part").agg(F.count("*").alias("c"))
    main = counted.groupBy("token").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main")
    rest = found.join(main, "token").where("part <> main")
    x, y = rest.alias("x"), found.alias("y")
    common = f"{SIMILARITY / (1 + SIMILARITY)!r}D * (x.n + y.n) - 1e-9D"
    once = "x.part <> y.part and (y.part = x.main or x.key < y.key)"
    apart = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in parity)
    near = f"{apart} <= {(1 - SIMILARITY) / (1 + SIMILARITY)!r}D * (x.n + y.n) + 1e-9D"
    pairs = x.join(y, F.expr(f"x.token = y.token and {once} and x.n - x.at >= {common} and y.n - y.at >= {common} and {near}"))
    return pairs.select(F.least("x.key", "y.key").alias("u"), F.greatest("x.key", "y.key").alias("v")).distinct()


def verified_links(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, name: str, words: Callable[[bytes], list[bytes]]) -> DataFrame:
    """Those of some pairs of keys of which the Jaccard similarity is 0.8 or more, by their whole shingle sets; written once."""
    pairs = written(pairs, f"{name}-pairs")
    keys = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    wanted = distinct.join(keys, "key").select(F.col("first").alias("doc_id"), F.col("key").alias("id"), "at", "n")
    sets = _looked_up(docs, wanted, f"{name}-shingles", _paragraph, words)
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("found").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("found").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    both = both.select("u", "v", shared.alias("s"), (F.size("a") + F.size("b") - shared).alias("t"))
    return written(both.where(F.col("s") >= SIMILARITY * F.col("t")).select("u", "v"), f"{name}-links")


def _copies(units: DataFrame) -> DataFrame:
    """``(doc_id, at, n, source)``: whole documents to cut, since an earlier one has the same text."""
    texts = units.where(F.col("words") >= LEAST_WORDS).select("doc_id", "text_key", "words")
    firsts = texts.groupBy("text_key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source <> last").select("text_key", "source")
    copies = texts.join(small(written(firsts, "repeated-texts")), "text_key").where("doc_id <> source").groupBy("doc_id").agg(F.max("words").alias("n"), F.min("source").alias("source"))
    return written(copies.select("doc_id", F.lit(0).cast("long").alias("at"), "n", "source"), "copies")


def _paragraph_cuts(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``(doc_id, at, n, source)``: whole paragraphs to cut."""
    lines = units.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.*")
    each = lines.groupBy(F.col("key").alias("text")).agg(F.min(F.struct("doc_id", "at", "n")).alias("x"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"))
    each = each.select(F.monotonically_increasing_id().alias("key"), "text", F.col("x.doc_id").alias("first"), "last", "x.at", "x.n", "bands")
    distinct = written(each, "paragraphs")
    parts = connected_components(similar_paragraphs(docs, distinct))
    grouped = distinct.select("key", "text", "first", "last").join(parts, distinct["key"] == parts["node"], "left").select("text", "first", "last", F.coalesce("component", "key").alias("part"))
    sources = grouped.groupBy("part").agg(F.min("first").alias("source"))
    repeated = grouped.join(sources, "part").where("last <> source").select("text", "source")
    repeated = small(written(repeated, "repeated-paragraphs"))
    return lines.select("doc_id", "at", "n", F.col("key").alias("text")).join(repeated, "text").where("doc_id <> source").select("doc_id", "at", "n", "source")


def _passage_cuts(docs: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, at, n, source)``: passages within or across paragraphs to cut, each held as a whole by its source, and
    there outside of ``paragraphs``, which are cut themselves for being similar to others and so may hold words of their own.

    Equal runs of 50 words share an anchor, so only runs that hold an anchor of several documents are listed; of
    these each that an earlier document has is a hit, and hits of one source that follow each other are a passage.
    """
    anchors = units.select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.at", "x.key")
    repeated = anchors.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source <> last").select("key")
    repeated = small(written(repeated, "repeated-anchors"))
    wanted = written(anchors.join(repeated, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("anchors")), "anchors")
    windows = docs.join(small(wanted, "anchors"), "doc_id").select("doc_id", "raw", "anchors").mapInArrow(_windows, "doc_id bigint, at bigint, key bigint")
    windows = written(windows, "windows")
    gone = written(paragraphs.groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("gone")), "paragraph-spans")
    inside = F.exists("gone", lambda g: (F.col("at") < g["at"] + g["n"]) & (g["at"] < F.col("at") + LEAST_WORDS))
    stays = windows.join(small(gone, "gone"), "doc_id", "left").where(F.col("gone").isNull() | ~inside)
    firsts = stays.groupBy("key").agg(F.min("doc_id").alias("source")).join(windows.groupBy("key").agg(F.max("doc_id").alias("last")), "key")
    firsts = firsts.where("source < last").select("key", "source")
    hits = windows.join(small(written(firsts, "repeated-runs")), "key").where("doc_id > source").select("doc_id", "source", "at")
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "source").orderBy("at"))
    runs = hits.withColumn("run", F.col("at") - rank).groupBy("doc_id", "source", "run").agg(F.min("at").alias("at"), F.max("at").alias("end"))
    return runs.select("doc_id", "at", (F.col("end") - F.col("at") + LEAST_WORDS).alias("n"), "source")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in ``spans`` (first word, words); a line that loses all its words goes whole,
    and what stays of a line on either side of a cut is joined by one space."""
    gone = set()
    for at, n in spans:
        gone.update(range(at, at + n))
    out, word = [], 0
    for line in text.split("\n"):
        places = [m.span() for m in _WORD.finditer(line)]
        kept = [i for i in range(len(places)) if word + i not in gone]
        word += len(places)
        if len(kept) == len(places):
            out.append(line)
        elif kept:
            runs: list[list[int]] = []
            for i in kept:
                if runs and runs[-1][1] == i - 1:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
            out.append(" ".join(line[places[a][0] : places[b][1]] for a, b in runs))
    return "\n".join(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _few(batches):
        texts = [t if t is None or not s else cut_words(t, [(x["at"], x["n"]) for x in s]) for t, s in zip(b.column("_lodscape_text").to_pylist(), b.column("_lodscape_spans").to_pylist())]
        at = b.schema.get_field_index("_lodscape_text")
        yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))


def cut_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text`` without repeated passages, plus ``n_cut_words`` and ``repeats_of``
    (the ids of documents that keep what was cut, ascending).

    Paragraphs (lines of 50 words or more) are banded by MinHash of five-word shingles; those that
    share a band and have a Jaccard similarity of 0.8 or more are one component. Passages that are no
    whole paragraph are found by the hashes of all runs of 50 words that hold a content-defined anchor
    of several documents: each run that an earlier document holds too, and keeps, is cut. Whole copies are found by their text first, so that
    they take part as one document. A component or passage stays in the document with
    the smallest id, wherever it stands there, and is cut from all others.

    Null texts stay null; rows without an id are left alone; rows that repeat an id are one document;
    texts of any length are read whole; columns named like the results are replaced; an empty table
    stays empty.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_cut_words", "repeats_of")]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw")).where("doc_id is not null")
    schema = "doc_id bigint, text_key binary, words bigint, lines array<struct<at:bigint,n:bigint,key:binary,bands:array<bigint>>>, anchors array<struct<at:bigint,key:bigint>>"
    units = written(own.mapInArrow(_units, schema), "units")
    copies = _copies(units)
    units = units.join(small(copies.select("doc_id")), "doc_id", "left_anti")
    paragraphs = written(_paragraph_cuts(own, units), "paragraph-cuts")
    cuts = copies.union(paragraphs).union(_passage_cuts(own, units, paragraphs))
    spans = cuts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("at", "n", "source"))).alias("_lodscape_spans"))
    spans = written(spans, "cuts").withColumnRenamed("doc_id", "_lodscape_id")
    keyed = docs.select(*[docs[c] for c in kept], docs[doc_id].cast("long").alias("_lodscape_id"), docs[text].cast("string").alias("_lodscape_text"))
    joined = keyed.join(small(spans, "_lodscape_spans"), "_lodscape_id", "left")
    fields = joined.schema
    out = joined.where("_lodscape_spans is null").unionByName(joined.where("_lodscape_spans is not null").mapInArrow(_cut, fields))
    words = F.expr("""aggregate(coalesce(_lodscape_spans, array()), named_struct('end', 0L, 'n', 0L),
        (acc, x) -> named_struct('end', greatest(acc.end, x.at + x.n), 'n', acc.n + greatest(0L, x.at + x.n - greatest(acc.end, x.at))), acc -> acc.n)""")
    sources = F.array_sort(F.array_distinct(F.coalesce(F.transform("_lodscape_spans", lambda s: s["source"]), F.array().cast("array<bigint>"))))
    return out.select(*[F.col("_lodscape_text").alias(c) if c == text else F.col(c) for c in kept], words.alias("n_cut_words"), sources.alias("repeats_of"))
