"""Two tokenizers' cuts of the same texts, aligned: where both end a token, what lies between, and which ids go together.

Both tokenizers begin a new token at each single blank before a word, so long texts are cut there and encoded part by part.
The cumulative ends of both sides' tokens, two sorted lists, are merged. Links are counted over the whole corpus by Spark, in
blocks of documents, and what a link's count and its sides' maxima are comes back to each block once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .blocks import Lookup, few_rows_at_once, packed, unpacked, written_blocks
from .common import byte_characters, kept_alone, written

#: Characters that are encoded at once, of one text and of several; links of a block, by whole texts.
PART, AT_ONCE, BLOCK_LINKS = 1 << 16, 1 << 19, 1 << 19
#: Documents that are passed to a worker at once while they are aligned: a document's groups and links are several times its text.
ROWS = 256

# How byte-level vocabularies split a text before their merges, and how piece vocabularies write a blank.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "▁"

_NONE = np.empty(0, dtype=np.int64)
_NEW = [StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("n_groups", LongType()), StructField("groups", StringType()), StructField("links", BinaryType())]


def byte_level(path: str):
    """(function on texts that gives their ids, bytes by id) of a byte-level BPE file whose ids follow the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    of, special = byte_characters(), {t["content"] for t in whole["added_tokens"]}
    ranks = {bytes(of[c] for c in token): k for token, k in whole["model"]["vocab"].items() if token not in special}
    merges = [m if isinstance(m, str) else " ".join(m) for m in whole["model"]["merges"]]
    order = [ranks[bytes(of[c] for c in m.replace(" ", "", 1))] for m in merges]
    if order != sorted(order) or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["normalizer"]:
        raise ValueError(f"{path} is not a byte-level vocabulary whose ids follow its merges")
    encoding = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return (lambda texts: [encoding.encode_to_numpy(t, disallowed_special=()) for t in texts]), _by_id({k: b for b, k in ranks.items()})


def pieces(path: str):
    """(function on texts that gives their ids, bytes by id) of a piece model; it puts a blank before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = {k: bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(BLANK, " ").encode() for k in range(model.get_piece_size()) for p in [model.id_to_piece(k)]}
    return (lambda texts: model.encode(texts, num_threads=1)), _by_id(spelled)


def _by_id(spelled: dict[int, bytes]) -> list[bytes]:
    return [spelled.get(k, b"") for k in range(max(spelled) + 1)]


def parts(text: str, size: int | None = None) -> list[str]:
    """A text that begins with a blank, cut after every ``size`` characters or more before a blank that neither follows a blank nor
    precedes white space; where there is no such blank it goes on."""
    size, out, start, at = size or PART, [], 0, 0
    while (at := text.find(" ", max(at + 1, start + size))) >= 0:
        if text[at - 1] != " " and at + 1 < len(text) and not text[at + 1].isspace():
            out.append(text[start:at])
            start = at
    return [*out, text[start:]]


def merged_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two growing lists of token ends meet: positions in the one and in the other. For each end of B a pointer
    into A goes on to the first end that is no smaller."""
    at = np.searchsorted(a_ends, b_ends)
    meet = a_ends[np.minimum(at, len(a_ends) - 1)] == b_ends
    return at[meet], np.flatnonzero(meet)


class Aligner:
    """Aligns some texts at a time."""

    def __init__(self, a_path: str, b_path: str):
        (self.encode_a, self.a_bytes), (self.encode_b, self.b_bytes) = byte_level(a_path), pieces(b_path)
        self.a_length, self.b_length = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id with what follows it: of A within and at the end of a group, then of B
        self.written = [f"{k}{c}" for t, within, last in ((self.a_bytes, ",", "|"), (self.b_bytes, ",", ";")) for k in range(len(t)) for c in (within, last)]

    def _encoded(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids, none if a side doesn't spell the text."""
        cut = parts(" " + text) if text else []
        b = [t for p in self.encode_b([p[1:] for p in cut]) for t in p] if len(cut) != 1 else self.encode_b([text])[0]
        a = [np.asarray(x, dtype=np.int64) for x in self.encode_a(cut)]
        ids = np.concatenate([_NONE, *a]), np.array(b, dtype=np.int64)
        spelled = (" " + text).encode() if text else b""
        # A is made of bytes, so its tokens can only fail to spell a text by their number of bytes
        same = self.a_length[ids[0]].sum() == len(spelled) and b"".join(map(self.b_bytes.__getitem__, b)) == spelled
        return ids if same else (_NONE, _NONE)

    def texts(self, batch: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, links) of each text."""
        found = [self._encoded(t) for t in batch]
        a_ids, b_ids = (np.concatenate([f[side] for f in found]) for side in (0, 1))
        if not len(a_ids):
            return [(0, 0, 0, "", b"")] * len(batch)
        # the texts lie one after the other, so one merge serves all of them and each ends with a group
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        a_last, b_last = merged_ends(a_ends, b_ends)
        links = (a_ids[a_last] << 32 | b_ids[b_last]).astype("<i8")
        a_is_last, b_is_last = np.zeros(len(a_ids), dtype=np.int64), np.zeros(len(b_ids), dtype=np.int64)
        a_is_last[a_last] = b_is_last[b_last] = 1
        a_group, b_group = np.cumsum(a_is_last) - a_is_last, np.cumsum(b_is_last) - b_is_last
        # before an A token stand the B tokens of earlier groups, before a B token the A tokens up to its own
        order = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        order[np.arange(len(a_ids)) + np.concatenate([[0], b_last + 1])[a_group]] = 2 * a_ids + a_is_last
        order[np.arange(len(b_ids)) + a_last[b_group] + 1] = 2 * (b_ids + len(self.a_bytes)) + b_is_last
        out, a, b, g = [], 0, 0, 0
        written = list(map(self.written.__getitem__, order.tolist()))
        a_text, b_text = np.cumsum([len(x) for x, _ in found]), np.cumsum([len(y) for _, y in found])
        closed = np.searchsorted(a_last, a_text)  # groups up to each text's end
        for a_end, b_end, g_end in zip(a_text.tolist(), b_text.tolist(), closed.tolist()):
            out.append((a_end - a, b_end - b, g_end - g, "".join(written[a + b : a_end + b_end])[:-1], links[g:g_end].tobytes()))
            a, b, g = a_end, b_end, g_end
        return out


@kept_alone
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def align_texts(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` and ``n_a, n_b, n_groups, groups, links``: each text's tokens by two vocabularies, aligned.

    A: a byte-level BPE file, on a blank and the text; B: a piece model, which puts that blank itself. ``groups``:
    ``a1,a2|b1;a3|b2,b3`` for the tokens between two places where both end one; ``links``: for each such place the two ids that end
    there, as 64-bit numbers A << 32 | B, little-endian. Special tokens' names in a text are plain text.

    A text that is null or empty, or that a side doesn't spell byte by byte (B writes U+2581 for a blank), has no tokens: zeros and empty
    values. Rows are taken one by one, repeated ones too; an empty table gives an empty result; columns with the new
    names are replaced. Long texts are encoded part by part; one without blanks is a single part.
    """
    kept = docs.select(*[c for c in docs.columns if c not in {f.name for f in _NEW}])
    schema = StructType([*kept.schema.fields, *_NEW])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for b in batches:
            texts, start, size = b.column(b.num_columns - 1), 0, 0
            for end in range(1, len(b) + 1):
                size += len(texts[end - 1].as_py() or "")
                if size >= AT_ONCE or end == len(b) or end - start == 512:
                    found = list(zip(*aligner.texts(texts.slice(start, end - start).to_pylist())))
                    new = [pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*b.slice(start, end - start).columns[:-1], *new], names=schema.names)
                    start, size = end, 0

    return kept.select("*", F.col(text).alias("_text")).mapInArrow(aligned, schema)


def link_blocks(aligned: DataFrame) -> DataFrame:
    """What :func:`align_texts` gave, without ``groups``, as blocks of documents with their different links; written once."""
    docs = aligned.select(*[c for c in aligned.columns if c not in ("groups", "links")], "links")
    entries = ArrayType(StructType([StructField("pair", LongType()), StructField("n", LongType())]))
    inner = StructType([*docs.schema.fields[:-1], StructField("_links", LongType())])
    schema = StructType([StructField("block", LongType()), StructField("docs", ArrayType(inner)), StructField("item", BinaryType()), StructField("entries", entries)])
    arrow = to_arrow_schema(schema)

    def block(number: int, rows: list[pa.StructArray], links: list[np.ndarray]) -> pa.RecordBatch:
        pair, item, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        all_rows, all_pairs = pa.concat_arrays(rows), pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(n.astype(np.int64))], names=["pair", "n"])
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (all_rows, all_pairs)]
        return pa.RecordBatch.from_arrays([pa.array([number]), lists[0].cast(arrow.field("docs").type), pa.array([packed(item)]), lists[1].cast(arrow.field("entries").type)], schema=arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, links, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            start = 0
            for end in range(1, len(b) + 1):
                links.append(np.frombuffer(b.column(b.num_columns - 1)[end - 1].as_py(), dtype="<i8"))
                size += len(links[-1])
                if size >= BLOCK_LINKS or end == len(b) or len(links) == 1 << 16:
                    lengths = pa.array([len(x) for x in links[start - end :]], pa.int64())
                    rows.append(pa.StructArray.from_arrays([*b.slice(start, end - start).columns[:-1], lengths], names=inner.names))
                    start = end
                    if size >= BLOCK_LINKS or len(links) >= 1 << 16:
                        number += 1
                        yield block(number, rows, links)
                        rows, links, size = [], [], 0
        if links:
            yield block(number + 1, rows, links)

    with few_rows_at_once(docs.sparkSession, ROWS):
        return written_blocks(docs.mapInArrow(cut, schema), "link-blocks")


def link_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, a, b, n, a_most, b_most)``: how many links of the corpus hold two ids linked, and the most that a link of either id counts."""
    counts = blocks.select(F.explode("entries").alias("e")).groupBy("e.pair").agg(F.sum("e.n").alias("n"))
    with few_rows_at_once(blocks.sparkSession):
        counts = written(counts.select("pair", F.shiftright("pair", 32).alias("a"), F.expr("pair & 4294967295L").alias("b"), "n"), "link-counts")
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("n").alias(f"{side}_most")), side)
    return counts.select("pair", "a", "b", "n", "a_most", "b_most")


def link_scores(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``blocks`` with ``n_links``, ``n_best`` (links whose count is the highest of their B id, ties included) and
    ``count_sum`` (over a document's links)."""
    table = written(counts.select("pair", (F.col("n") * 2 + (F.col("n") == F.col("b_most")).cast("long")).alias("answer")), "link-answers")
    inner = blocks.schema["docs"].dataType.elementType
    schema = StructType([*inner.fields[:-1], *[StructField(n, LongType()) for n in ("n_links", "n_best", "count_sum")]])

    lookup = Lookup(blocks, "entries", table, ["pair"], "answer")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                columns, each = b["docs"][k].values.flatten(), np.concatenate([[0], lookup.answers(b, k)[unpacked(b["item"][k].as_py())]])
                ends = np.cumsum(columns[-1].to_numpy())
                total = lambda v: np.diff(np.cumsum(v)[ends], prepend=0)
                sums = [columns[-1], *[pa.array(total(v)) for v in (each & 1, each >> 1)]]
                yield pa.RecordBatch.from_arrays([*columns[:-1], *sums], names=schema.names)

    with few_rows_at_once(blocks.sparkSession):
        return written(lookup.rows.mapInArrow(scored, schema), "link-scores")
