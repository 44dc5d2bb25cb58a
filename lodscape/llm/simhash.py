"""SimHash near-duplicates, found by deletion-variant signatures, and similar documents by exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import substrings
from .common import shuffle_width, with_computed, written
from .components import connected_components

#: A-Z to a-z in bytes of UTF-8.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: So many shingles of one text are unpacked to bits at a time.
_BLOCK = 1 << 16
#: Bands of 4 rows of a document's shingles: a pair at similarity 0.8 shares none with probability 0.00000005.
_BANDS = 32


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits as a signed number; bit b is 1 if set in over half of the shingles' XXH64 values.
    Words are runs of bytes other than 0x20 and 0x09-0x0D, which is what bytes.split() cuts at."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=len(shingles)))


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits as a signed number: those that over half of some 64-bit hashes have."""
    h = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[i : i + _BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<i8")[0])


def one_wildcard_keys(fp: str) -> Column:
    """64 keys of a fingerprint: each 32-bit half with one of its bits wiped, tagged by half and bit."""
    return F.expr(
        f"transform(sequence(0, 63), i -> (cast(i as bigint) << 32) | "
        f"((case when i < 32 then {fp} else shiftrightunsigned({fp}, 32) end) & 4294967295L & ~(1L << (i % 32))))"
    )


def two_wildcard_keys(fp: str) -> Column:
    """2016 keys, the whole fingerprint with two of its bits wiped: equal keys mean a distance of 2 at most."""
    pairs = f"flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(i * 64 + j as slot, {fp} & ~(1L << i) & ~(1L << j) as rest))))"
    return F.expr(pairs)


def fingerprint_links(prints: DataFrame, bucket: int = 1024) -> DataFrame:
    """Distinct ``(fp, node)`` rows -> ``(u, v)`` node links that join everything at distance 2 or less.

    Two fingerprints that differ in at most 2 bits have a half in which they differ in at most one,
    so they share a one-wildcard key of that half: an equality join on 64 keys a fingerprint finds
    every candidate and the bit count verifies it. Keys shared by more than ``bucket`` different
    fingerprints are left out of the join; the fingerprints on them are linked by two-wildcard keys
    instead, whose equality is already proof, as a star around the smallest: linear and exact too.
    """
    keyed = prints.repartition(shuffle_width(prints.sparkSession), "fp").select("fp", "node", F.explode(one_wildcard_keys("fp")).alias("key"))
    hot = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), "hot-keys")
    crowded = not hot.isEmpty()
    hot = substrings.small(hot)
    cold = keyed.join(hot, "key", "left_anti") if crowded else keyed
    a, b = cold.alias("a"), cold.alias("b").hint("merge")
    links = a.join(b, F.expr("a.key = b.key and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= 2")).select(
        F.col("a.node").alias("u"), F.col("b.node").alias("v")
    )
    if crowded:
        packed = keyed.join(hot, "key", "left_semi").select("fp", "node").distinct()
        sure = packed.select("node", F.explode(two_wildcard_keys("fp")).alias("key"))
        star = sure.groupBy("key").agg(F.min("node").alias("u"))
        links = links.union(sure.join(star.hint("merge"), "key").select("u", F.col("node").alias("v")))
    return links.where("u <> v").distinct()


def simhash_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bucket: int = 1024) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: the class of near-duplicates it is in.

    Copies share a fingerprint and are one node, named by their smallest id; null texts count as
    empty (fingerprint 0). Rows whose id is null keep their place, and get a null component only if
    no row of their fingerprint has an id. Repeated rows come back as often as they came in. Texts of any
    length are read whole, a block of shingles at a time; other columns, whatever their names, are
    left out; ties can't come up, as the smallest id names a class; an empty table gives an empty result.
    The driver gets no table of more than ``BROADCAST_ROWS`` rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = written(with_computed(own, "fp", LongType(), F.col("text"), lambda: fingerprint_of).select("doc_id", "fp"), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    parts = connected_components(fingerprint_links(nodes.where("node is not null"), bucket))
    classes = nodes.join(parts.hint("merge"), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(substrings.small(written(classes, "classes")), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bucket: int = 1024) -> DataFrame:
    """The rows of ``docs``, one document for each class of near-duplicates: the one with the smallest id.
    Rows without an id are kept; rows that repeat an id are one document and stay or go together; all columns are kept."""
    cls = simhash_classes(docs, doc_id=doc_id, text=text, bucket=bucket)
    gone = written(cls.groupBy("doc_id").agg(F.min("component_id").alias("first")).where("doc_id <> first").select("doc_id"), "near-copies")
    return _without(docs, doc_id, gone)


def _without(docs: DataFrame, doc_id: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose id is among ``gone``; an anti-join, so columns of any names may be there."""
    ids = gone.select(F.col("doc_id").alias("_lodscape_gone"))
    return docs.join(substrings.small(ids), docs[doc_id].cast("long") == ids["_lodscape_gone"], "left_anti")


def _lower_words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in substrings._few(batches):
        keys, sizes, prints, shingles = [], [], [], []
        for raw in part.column(2).to_pylist():
            words = _lower_words(raw)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(words))
            shingles.append(substrings.shingles_of(substrings.hashed_words(words)))
            prints.append(majority_bits(shingles[-1]))
        each = np.array([len(s) for s in shingles])
        bands = substrings.bands_of(np.concatenate(shingles), np.cumsum(each) - each, _BANDS)
        banded = substrings._lists(np.full(len(bands), _BANDS), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), banded], names=["doc_id", "place", "text", "n", "fp", "bands"])


def drop_similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one document for each component of those whose five-word shingles (A-Z as a-z) have a
    Jaccard similarity of 0.8 or more: the one with the smallest id.

    Texts whose fingerprints (of these shingles) differ in at most 2 bits are found by :func:`fingerprint_links`. Pairs at
    similarity 0.8 differ in about 10 of 64 bits and now and then in 18, where no key of a fingerprint is both sure and
    rare; so what is not joined by then and shares a MinHash band are candidates too. The shingle sets of all candidates are compared. Null texts count as empty; texts of any length are compared whole; rows without an id are kept; rows
    that repeat an id are one document; all columns, whatever their names, are kept; an empty table stays empty.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw")).where("doc_id is not null")
    own = own.select("doc_id", F.xxhash64("doc_id", "raw").alias("place"), "raw")
    units = written(own.mapInArrow(_banded, "doc_id bigint, place bigint, text binary, n bigint, fp bigint, bands array<bigint>"), "documents")
    each = units.groupBy("text").agg(F.min(F.struct("doc_id", "place", "n")).alias("x"), F.max("doc_id").alias("last"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    each = each.select(F.monotonically_increasing_id().alias("key"), "text", F.col("x.place").alias("first"), F.lit(0).cast("long").alias("at"), "x.n", "fp", "bands", "x.doc_id", "last")
    distinct = written(each, "texts")
    places = own.select(F.col("place").alias("doc_id"), "raw")
    nodes = written(distinct.groupBy("fp").agg(F.min("key").alias("node"), F.max("key").alias("last")), "nodes")
    equal = distinct.join(substrings.small(nodes.where("node <> last")), "fp").where("key <> node").select(F.col("node").alias("u"), F.col("key").alias("v"))
    near = fingerprint_links(nodes.select("fp", "node")).union(equal)
    paragraphs = distinct.select("key", "first", "at", "n", "bands")
    near = substrings.verified_links(places, paragraphs, near.distinct(), "fingerprint", _lower_words)
    parts = connected_components(near.union(substrings.similar_paragraphs(places, paragraphs, _lower_words, near)))
    grouped = distinct.select("key", "text", "doc_id", "last").join(parts, distinct["key"] == parts["node"], "left").select("text", "doc_id", "last", F.coalesce("component", "key").alias("part"))
    sources = grouped.groupBy("part").agg(F.min("doc_id").alias("source"))
    repeated = written(grouped.join(sources, "part").where("last <> source").select("text", "source"), "repeated-texts")
    gone = units.select("doc_id", "text").join(substrings.small(repeated), "text").where("doc_id <> source").select("doc_id").distinct()
    return _without(docs, doc_id, written(gone, "near-copies"))
