"""Tokens of documents, packed into as few sequences of a fixed length as can be."""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_characters, give_back, kept_alone, written

# Characters whose lower case and normal form are one character each, and how the tokenizer cuts words of them.
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_SIMPLE_LINES = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_CUT = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\na-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
#: What ends a piece of a word, as a byte that no simple word has and as the vocabulary writes it.
_END, _SUFFIX = "\0", "</w>"

#: Rounds of packing at most: every one but the first and the last has saved a bin or halved the rows; the last closes all bins.
_ROUNDS = 64
#: Words whose ids a worker keeps at most, their bytes at most, and bytes of texts (one text at least) that are encoded at once (first and last unless told otherwise).
_KNOWN, _LONGEST, _AT_ONCE = 400_000, 64, 1 << 22


def _sliced(values: pa.Array) -> list[bytes]:
    """The values of a column of large binaries without nulls; much faster than to_pylist."""
    _, offsets, raw = values.buffers()
    if not len(values):
        return []
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    whole = b"" if raw is None else raw.to_pybytes()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def _pieces_encoder(path: str, model: dict) -> Callable[[str], np.ndarray]:
    """Ids of pieces of words, each closed by :data:`_END`, by the file's merges, which tiktoken runs: a piece's last byte and
    its end are one symbol, as the file's suffix says, so they come first. The merges of a pair whose parts the file makes later,
    or of a token that it makes twice, could go another way, so such a file is refused."""
    import tiktoken

    of, vocab = byte_characters(), model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    names = [*sorted(of, key=of.__getitem__), *(c + _SUFFIX for c in of if of[c]), *(a + b for a, b in merges)]
    place = {name: k for k, name in enumerate(names)}
    early = all(max(place.get(a, len(names)), place.get(b, len(names))) < place[a + b] for a, b in merges)
    if not early or len(place) < len(names) or model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or model["ignore_merges"]:
        raise ValueError(f"{path} is not a vocabulary of words that its merges make in turn")
    spelled = [bytes(of[c] for c in name.removesuffix(_SUFFIX)) + _END.encode() * name.endswith(_SUFFIX) for name in names]
    ids = np.array([vocab[name] for name in names], dtype="<u4")
    encoding = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks={raw: k for k, raw in enumerate(spelled)}, special_tokens={})
    return lambda text: ids[encoding.encode_to_numpy(text, disallowed_special=())]


class WordEncoder:
    """Encodes texts (UTF-8) to ids (little-endian unsigned 32 bits), for a tokenizer that drops white space.

    Its pre-tokenizer never joins what white space parts, so the ids of a text are those of its
    white-space-separated words in turn, and each word's are kept for its next occurrence. The different words of some texts that are
    not kept are encoded at once: those of ASCII and Latin-1 letters are lower-cased and cut here and given to the tokenizer's
    merges, all others go through the whole tokenizer, one by one.
    """

    def __init__(self, path: str, remembered: int | None = None, at_once: int | None = None):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._path, self._most, self._at_once, self._pieces = path, remembered, at_once, _pieces_encoder(path, file["model"])
        self._special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or "(?!)")
        self._line = self._pieces("\n" + _END)[0]
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    @functools.cached_property
    def _tokenizer(self):
        """Read when the first word needs it: it takes as much memory as all the rest."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path)

    def __call__(self, text: bytes | None) -> bytes:
        return self.encode([text])[0]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each of some texts."""
        return [ids for part in self.encode_column(pa.array(texts, pa.large_binary())) for ids in part]

    def encode_column(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of each of some texts (a binary or string column), some texts at once."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends, begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + (self._at_once or _AT_ONCE), "right")))
            yield self._encoded(texts.slice(begin, end - begin).view(pa.large_string()))
            begin = end

    def _encoded(self, texts: pa.Array) -> list[bytes]:
        """Arrow splits the texts, tells different words and sets their ids in turn; so a word is looked up once here, however often it occurs."""
        parted = pc.ascii_split_whitespace(texts)
        words = parted.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(_sliced(words.dictionary.view(pa.large_binary()))), pa.large_binary()).take(words.indices)
        _, offsets, raw = ids.buffers()
        of_words = np.frombuffer(offsets, dtype=np.int64) if len(ids) else np.zeros(1, dtype=np.int64)
        at = pa.py_buffer(of_words[parted.offsets.to_numpy() - parted.offsets[0].as_py()])
        return _sliced(pa.Array.from_buffers(pa.large_binary(), len(texts), [None, at, raw]))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some different words."""
        out = list(map(self._known.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if len(self._known) + len(missing) > (_KNOWN if self._most is None else self._most) // 2:
            self._older, self._known = self._known, {w: ids for w, ids in zip(words, out) if ids is not None}
        for k in missing:
            out[k] = self._older.get(words[k])
        new = [k for k in missing if out[k] is None]
        for k, ids in zip(new, self._of_words([words[k] for k in new])):
            out[k] = ids
        self._known.update((words[k], out[k]) for k in missing if len(words[k]) <= _LONGEST)
        return out

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        whole = b"\n".join(words).decode("utf-8", "replace")
        special = self._special.search(whole) is not None
        if not special and _SIMPLE_LINES.fullmatch(whole):
            return self._of_simple(whole)
        of = whole.split("\n")
        simple = [bool(_SIMPLE.fullmatch(w)) and not (special and self._special.search(w)) for w in of]
        cut = iter(self._of_simple("\n".join(itertools.compress(of, simple))))
        return [next(cut) if s else np.array(self._tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w, s in zip(of, simple)]

    def _of_simple(self, lines: str) -> list[bytes]:
        """The ids of each line of simple words."""
        ids = self._pieces(_END.join(_CUT.findall(lines.lower())) + _END) if lines else np.zeros(0, dtype="<u4")
        ends, raw = np.flatnonzero(ids == self._line) * 4, ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]


@kept_alone
def word_encoder(path: str, remembered: int | None = None, at_once: int | None = None) -> WordEncoder:
    """The encoder of a tokenizer's file; a worker makes one and keeps it."""
    encoder = WordEncoder(path, remembered, at_once)
    give_back()
    return encoder


def token_pieces(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", remembered: int | None = None, at_once: int | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: every document's ids and ``end_id``, cut into pieces of ``size``.

    ``ids`` is binary, little-endian unsigned 32-bit numbers. Only documents longer than ``size`` are
    cut, the last piece may be shorter. Null and empty texts are the one id ``end_id``; repeated rows
    give repeated pieces; rows whose id is null are kept; other columns are left out; texts of any length are encoded
    whole; an empty table gives no pieces. There are no ties: a piece's ids depend on its text alone. ``remembered``: words whose
    ids a worker keeps at most, ``at_once``: bytes of texts (one text at least) that it encodes at once; both change time and memory only.
    """
    closing = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, remembered, at_once)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            names = iter(b.column(0).to_pylist())
            for texts in encoder.encode_column(b.column(1)):
                rows: list[tuple] = []
                for ids in texts:
                    name, ids = next(names), ids + closing
                    for p, start in enumerate(range(0, len(ids), 4 * size)):
                        piece = ids[start : start + 4 * size]
                        rows.append((name, p, start // 4, len(piece) // 4, piece))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        give_back()

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def fill_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: best fit of the longest first, then a local search.

    The search exchanges one for one, two for one or one for two, or moves documents, always from an
    emptier underfull bin to a fuller one, so that the sum of squared fills grows; a bin that loses
    its last document is gone. It ends when nothing improves or the bins are as few as their content allows.
    """
    bins: list[list[int]] = []
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have; stale ones are passed over
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        over = mask >> n
        if over:
            r = n + (over & -over).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - n
        if room[b]:
            with_room[room[b]].append(b)
            mask |= 1 << room[b]
    least = -(-sum(lengths) // capacity)
    alive = len(bins)
    improved = True
    while improved and alive > least:
        improved = False
        open_bins = sorted((b for b in range(len(bins)) if bins[b] and room[b]), key=lambda b: (room[b], b))
        donors: dict[int, dict[int, int]] = {}  # by length: positions in bins that may still give, with their bin
        for b in open_bins:
            for i in bins[b]:
                donors.setdefault(lengths[i], {})[i] = b
        held = sum(1 << n for n in donors)

        def leave(i: int) -> None:
            nonlocal held
            if donors.get(lengths[i], {}).pop(i, None) is not None and not donors[lengths[i]]:
                del donors[lengths[i]]
                held &= ~(1 << lengths[i])

        def largest(limit: int) -> int:
            return (held & ((1 << (limit + 1)) - 1)).bit_length() - 1

        def shift(a: int, out: list[int], into: list[int]) -> None:
            """Documents ``into`` go to bin a, its ``out`` to the bin that the first of them comes from."""
            nonlocal alive
            sources = [donors[lengths[i]][i] for i in into]
            for i, b in zip(into, sources):
                leave(i)
                bins[b].remove(i)
                bins[a].append(i)
                room[b] += lengths[i]
                room[a] -= lengths[i]
            b = sources[0]
            for i in out:
                bins[a].remove(i)
                bins[b].append(i)
                room[b] -= lengths[i]
                room[a] += lengths[i]
                donors.setdefault(lengths[i], {})[i] = b
            alive -= sum(not bins[b] for b in set(sources))

        for a in open_bins:
            for i in bins[a]:  # a bin takes from those after it only
                leave(i)
            held = sum(1 << n for n in donors)
            while room[a] and held:
                gap, best = room[a], None
                alike: dict[int, list[int]] = {}  # different lengths in a bin are few, so all their pairs are too
                for i in bins[a]:
                    alike.setdefault(lengths[i], []).append(i)
                own: dict[int, list[int]] = {0: []} | {n: same[:1] for n, same in alike.items()}
                singles = sorted(own)
                for m, same in alike.items():
                    for n, others in alike.items():
                        if n < m:
                            own.setdefault(m + n, [same[0], others[0]])
                    if len(same) > 1:
                        own.setdefault(2 * m, same[:2])
                for n, out in own.items():
                    y = largest(n + gap)
                    if y > n and (best is None or y - n > best[0]):
                        best = (y - n, out, [y])
                        if y - n == gap:
                            break
                if best is None or best[0] < gap:
                    for n in singles:
                        total = n + gap
                        rest = held & ((1 << (total // 2 + 1)) - 1)
                        while rest:
                            y = rest.bit_length() - 1
                            rest &= ~(1 << y)
                            z = total - y
                            if z in donors and (z != y or len(donors[y]) > 1):
                                best = (gap, own[n], [z, y])
                                break
                        if best is not None and best[0] == gap:
                            break
                if best is None:
                    break
                _, out, wanted = best
                into: list[int] = []
                for n in wanted:
                    into.append(next(i for i in donors[n] if i not in into))
                b = donors[lengths[into[0]]][into[0]]
                if len(wanted) == 2 and out and room[b] + lengths[into[0]] < sum(lengths[i] for i in out):
                    break
                shift(a, out, into)
                improved = True
                if alive <= least:
                    break
            if alive <= least:
                break
    return [b for b in bins if b]


def pack(pieces: DataFrame, *, size: int = 2048, length: str = "length", group_rows: int = 4096) -> DataFrame:
    """All columns of ``pieces`` plus ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Rows are dealt evenly into groups of about ``group_rows``, each packed by :func:`fill_bins` in one
    task. What a group leaves in bins that lack more than a 256th is dealt anew with the leavings of the others,
    until one group is left, or a round neither saves a bin nor halves the rows; so the result wastes about what one
    group wastes and at most a 256th more, whatever the number of rows. A row longer than ``size`` or without a length is an error of the caller.
    Repeated rows are packed one by one; equal lengths go in the order of the rows; columns named like
    the results are replaced; other columns, whatever their names or nulls, are kept; an empty table stays empty.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*kept).dtypes)
    fields = f"{schema}, sequence_id long, offset long, _lodscape_left boolean"

    def packer(round_no: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_lodscape_row", ignore_index=True)
            n = [int(x) for x in rows[length]]
            bins = fill_bins(n, size)
            sequence, offset, left, order = [], [], [], []
            for b, members in enumerate(bins):
                fill = sum(n[i] for i in members)
                at = 0
                for i in members:
                    order.append(i)
                    sequence.append((round_no << 36 | int(key[0])) << 20 | b)
                    offset.append(at)
                    left.append(not last and fill < size - size // 256)
                    at += n[i]
            out = rows.iloc[order][kept].reset_index(drop=True)
            out["sequence_id"], out["offset"], out["_lodscape_left"] = sequence, offset, left
            return out

        return packed

    rest, done, bins_left, last, round_no = pieces.select(*kept), None, None, False, 0
    while not last:
        rows = rest.count()
        groups = max(1, -(-rows // group_rows))
        last = groups <= 2 or round_no == _ROUNDS - 1
        groups = 1 if last and groups <= 2 else groups
        dealt = rest.withColumn("_lodscape_row", F.monotonically_increasing_id()).withColumn("_lodscape_group", F.pmod(F.xxhash64("_lodscape_row"), F.lit(groups)))
        out = written(dealt.groupBy("_lodscape_group").applyInPandas(packer(round_no, last), fields), f"packed-{round_no}")
        if not last:
            full, bins, n = out.agg(
                F.count_distinct(F.when(~F.col("_lodscape_left"), F.col("sequence_id"))), F.count_distinct(F.when(F.col("_lodscape_left"), F.col("sequence_id"))), F.count_if("_lodscape_left")
            ).first()
            last = n == 0 or bins_left is not None and full + bins >= bins_left and 2 * n > rows
            bins_left = bins
        ready = (out if last else out.where("not _lodscape_left")).drop("_lodscape_left")
        done = ready if done is None else done.unionByName(ready)
        rest, round_no = out.where("_lodscape_left").select(*kept), round_no + 1
    return done


def pack_documents(docs: DataFrame, tokenizer: str, *, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", remembered: int | None = None, at_once: int | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids, sequence_id, offset)`` for every piece of every document.
    Ids are written once and moved once; what is packed in rounds is only the pieces' lengths.
    Nulls, empty and very long texts, repeated rows, other columns, empty tables, ``remembered`` and ``at_once``: as in :func:`token_pieces`."""
    pieces = token_pieces(docs, tokenizer, size=size, end_id=end_id, doc_id=doc_id, text=text, remembered=remembered, at_once=at_once)
    pieces = written(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    plan = pack(pieces.select("_piece", "length"), size=size)
    return pieces.join(plan.select("_piece", "sequence_id", "offset"), "_piece").drop("_piece")
