"""Phrases that stand together more often than chance: vertical position lists of phrases, grown word by word.

Texts become blocks of word occurrences. In a block each frequent phrase has the sorted list of the positions where it
starts, and it grows by a merge of that list with the lists of what stands one position further: of the adjacent
words, kept only where the words up to them are frequent too. The length of a list, summed over blocks, is the phrase's exact
frequency. Between two lengths Spark sums the lengths of all lists and tells each block which of its phrases are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Lookup, few_rows_at_once, packed, packed_places, unpacked, unpacked_places, written_blocks
from .common import written

#: Words of a block, by whole texts; bytes of a text that are split into words at once.
BLOCK_WORDS, SLICE = 1 << 19, 1 << 20

# Capitals and their small letters; what ends a piece, a full stop for all of it here; what stands between words.
_CAPITALS, _SMALL, _ENDS, _BLANKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes.maketrans(_CAPITALS + _ENDS + _BLANKS, _SMALL + b"." * len(_ENDS) + b" " * len(_BLANKS))

_LISTS = "block long, lang string, at binary, item binary, "
_ARROW = [("block", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("item", pa.binary())]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def words_and_ends(text: bytes) -> Iterator[list[bytes]]:
    """A text's words in order with ``.`` where a piece ends, a bounded part at a time."""
    text, start = text.translate(_TABLE), 0
    while start < len(text):
        end = text.find(b" ", start + SLICE)
        end = len(text) if end < 0 else end
        yield text[start:end].replace(b".", b" . ").split()
        start = end


def _row(schema: pa.Schema, values: list, entries: pa.StructArray, *more: int) -> pa.RecordBatch:
    """One block with its list of entries and what comes after it."""
    lists = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
    return pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(values, schema)], lists, *[pa.array([v]) for v in more]], schema=schema)


def _word_blocks(docs: DataFrame) -> DataFrame:
    """``(block, lang, at, item, entries(phrase, n), n_words)``: position and word of each occurrence; pieces are a position apart."""
    schema = pa.schema([*_ARROW, ("entries", pa.list_(pa.struct([("phrase", pa.string()), ("n", pa.int64())]))), ("n_words", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # of each language its words' numbers, its texts' words, and their number
        number = TaskContext.get().partitionId() << 32

        def block(lang: str) -> pa.RecordBatch:
            nonlocal number
            names, parts, _ = held.pop(lang)
            seq = np.concatenate(parts)
            at = np.flatnonzero(seq)
            item = seq[at] - 1
            n = np.bincount(item, minlength=len(names) - 1)
            number += 1
            entries = pa.StructArray.from_arrays([pa.array(list(names)[1:], pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["phrase", "n"])
            return _row(schema, [number, lang, packed_places(at), packed(item)], entries, len(at))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                if lang not in held:
                    held[lang] = [_Numbers({b".": 0}), [np.zeros(1, dtype=np.int32)], 0]
                own = held[lang]
                for words in words_and_ends(text.as_py()):
                    own[1].append(np.fromiter(map(own[0].__getitem__, words), dtype=np.int32, count=len(words)))
                    own[2] += len(words)
                own[1].append(np.zeros(1, dtype=np.int32))
                own[2] += 1
                if own[2] >= BLOCK_WORDS:
                    yield block(lang)
                elif sum(o[2] for o in held.values()) >= 4 * BLOCK_WORDS:  # many languages with little each
                    yield from (block(k) for k in list(held))
        yield from (block(k) for k in list(held))

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _LISTS + "entries array<struct<phrase:string,n:long>>, n_words long")


def _grown(lists: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """Lists of phrases a word longer: where a frequent phrase starts and another at the next position, entries (a, b) name both."""
    schema = pa.schema([*_ARROW, ("entries", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])))])
    lookup = Lookup(lists.drop("n_words"), "entries", frequent.select(*keys, "id"), keys, "id")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                ids = lookup.answers(b, k)
                at, item = unpacked_places(b["at"][k].as_py()), unpacked(b["item"][k].as_py())
                known = ids[item] >= 0
                at, item = at[known], item[known]
                # lists are sorted by position, so the merge with the next position's lists looks at neighbours only
                meet = np.flatnonzero(at[1:] == at[:-1] + 1)
                number = ids[item]
                # sorted by both numbers, as neighbouring rows that begin alike take fewer bytes in files and shuffles
                pair, place, count = np.unique(number[meet] << 32 | number[meet + 1], return_inverse=True, return_counts=True)
                if len(pair):
                    entries = pa.StructArray.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(count.astype(np.int64))], names=["a", "b", "n"])
                    yield _row(schema, [b["block"][k].as_py(), b["lang"][k].as_py(), packed_places(at[meet]), packed(place)], entries)

    return lookup.rows.mapInArrow(grow, _LISTS + "entries array<struct<a:long,b:long,n:long>>")


def _numbered(counts: DataFrame, name: str) -> DataFrame:
    """``counts`` with ``id`` 0, 1, 2, ...: the most frequent phrases have the smallest numbers, which take the fewest bytes in shuffles."""
    laid = counts.repartitionByRange(F.desc("f")).sortWithinPartitions(F.desc("f")).withColumn("_id", F.monotonically_increasing_id())
    laid = written(laid, f"{name}-counted").withColumn("_task", F.shiftright("_id", 33))  # a number in its task below the task's own
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = laid.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return written(laid.join(F.broadcast(offsets), "_task").select(*counts.columns, F.expr("(_id & 8589934591L) + _before").alias("id")), name)


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``(id, lang, words, phrase, last, f)`` of all phrases of up to ``longest`` words that occur ``least`` times, and ``(lang, n)``.

    One pass over the texts; each further length reads the lists of the one before. What is passed between tasks is one row
    for each different phrase of a block.
    """
    lists = written_blocks(_word_blocks(docs), "word-lists")
    with few_rows_at_once(docs.sparkSession):
        n = written(lists.groupBy("lang").agg(F.sum("n_words").alias("n")), "words")
        counts = lists.select("lang", F.explode("entries").alias("e")).groupBy("lang", F.col("e.phrase").alias("phrase")).agg(F.sum("e.n").alias("f")).where(F.col("f") >= least)
        level = _numbered(counts.select("lang", F.lit(1).alias("words"), "phrase", F.col("phrase").alias("last"), "f"), "phrases-1")
        levels, keys = [level], ["lang", "phrase"]
        for words in range(2, longest + 1):
            lists = written_blocks(_grown(lists, level, keys), f"phrase-lists-{words}")
            keys = ["a", "b"]
            counts = lists.select(F.explode("entries").alias("e")).groupBy("e.a", "e.b").agg(F.sum("e.n").alias("f")).where(F.col("f") >= least)
            head, tail = level.select(F.col("id").alias("a"), "lang", "phrase"), level.select(F.col("id").alias("b"), "last")
            named = counts.join(head, "a").join(tail, "b")
            phrase = F.concat_ws(" ", "phrase", "last").alias("phrase")
            level = _numbered(named.select("lang", F.lit(words).alias("words"), phrase, "last", "f", "a", "b"), f"phrases-{words}")
            levels.append(level.drop("a", "b"))
    return reduce(DataFrame.unionByName, levels), n


def mine_collocations(docs: DataFrame, *, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at blanks and tabs. A phrase
    occurs ``a`` times, all contiguous places within pieces; candidates have ``a >= least``. Cut into a first part (``l`` times)
    and the rest (``r``), it scores floor(1000 a n / (l r)), n being its language's words; the cut with the lowest score counts, of
    equal ones the earliest. A candidate that only ever stands inside a longer one is dropped. Order: score, a (both
    descending), phrase in byte order. Products are decimals of 38 digits, so exact up to 10^11 or so occurrences of 10^14 words.

    A null text is empty, a null language ``und``; repeated rows count each; ids are not looked at; other columns are
    ignored; an empty table, or one without frequent phrases, gives an empty result. A text of any length is one block at least.
    """
    phrases, n = frequent_phrases(docs, least, longest)
    candidates = phrases.where("words >= 2").select("lang", "words", "phrase", F.col("f").alias("a"))
    # a phrase inside a longer one as frequent is also inside one that is a word longer and as frequent
    ends = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    inside = candidates.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "a").distinct()
    kept = candidates.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("cut"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - words)")})
    first, rest = (phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)) for part, count in (("first", "l"), ("rest", "r")))
    wide = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(n, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    wide = wide.withColumn("over", F.lit(1000).cast("decimal(4,0)") * big("a")).withColumn("under", big("l") * big("r")).withColumn("over", F.col("over") * big("n"))
    score = wide.withColumn("score", F.expr("over div under"))
    best = score.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    # ranked first among a sixteenth of a language's phrases, so one task meets no more than 16 times the report
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
