"""SentencePiece ids of texts by a streaming Viterbi search, and the texts back."""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType

from .common import Memo, with_computed

#: Pairs of pieces that a worker remembers at most.
_PAIRS = 300_000
#: What stands for a space.
SPACE = "▁"
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@functools.lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    """The codec of a model, made once in a worker."""
    return PieceCodec(model)


class PieceCodec:
    """Ids of texts under a model whose pieces are merged by score and never go on past a word's end.

    A sequence of pieces is the model's own if and only if each two neighbours are: merging their
    characters by score gives just these two. So, reading from the left, every prefix has one last
    piece, and what a Viterbi search keeps of a position is that piece and where it begins. Only
    positions within the longest piece's length of the reader can still be continued; when the
    backpointers of all of them meet in one boundary, the ids up to it are final and given out.
    """

    def __init__(self, model: str, commit_every: int = 64):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in plain}
        self._score = {p.id_to_piece(i): p.get_score(i) for i in plain}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces that go on past a space are not supported")
        self.longest = max(map(len, self.ids))
        self._unknown = p.unk_id()
        self._bytes = {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}
        self._commit_every = commit_every
        self._piece = {i: piece for piece, i in self.ids.items()}
        self._packed = [i.to_bytes(4, "little") for i in range(n)]
        #: Characters that stand next to each other in some piece: between any others all paths have a boundary.
        self._joined = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self._lines = not any("\n" in piece for piece in self.ids)
        #: By piece: the pieces tried after it, with their ids, or -1 if the two are not what their characters merge to.
        self._after: defaultdict[int, dict[str, int]] = defaultdict(dict)
        self._tried = 0
        self._known: Memo = Memo(self._unit, most=400_000)
        self._text = [b""] * n
        for piece, i in self.ids.items():
            self._text[i] = piece.replace(SPACE, " ").encode()
        for b, i in self._bytes.items():
            self._text[i] = bytes([b])
        self._text[self._unknown] = " ⁇ ".encode()

    def _merged(self, text: str, least: int = 1) -> list[str]:
        """The model's pieces of a short text: again and again the best-scored neighbours become one, the leftmost first,
        until ``least`` are left or none merge."""
        parts, score, none = list(text), self._score.get, -math.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > least and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
        return parts

    @functools.cached_property
    def _whole(self) -> dict[str, int]:
        """Pieces that merging their own characters gives, and single characters; no others can come up."""
        return {piece: i for piece, i in self.ids.items() if len(piece) == 1 or piece in self._halves}

    @functools.cached_property
    def _halves(self) -> dict[str, tuple[str, str]]:
        """The two parts that are merged last in each piece that merging its own characters gives."""
        merged = ((piece, self._merged(piece, 2)) for piece in self.ids if len(piece) > 1)
        return {piece: (parts[0], parts[1]) for piece, parts in merged if len(parts) == 2}

    @functools.cached_property
    def _turn(self) -> dict[str, float]:
        """When a piece is merged, by score, characters first; without pieces that come before one of their parts, or have such parts."""
        turn: dict[str, float] = {piece: -math.inf for piece in self._whole if piece not in self._halves}
        for piece in sorted(self._halves, key=len):
            a, b = self._halves[piece]
            if max(turn.get(a, math.inf), turn.get(b, math.inf)) < -self._score[piece]:
                turn[piece] = -self._score[piece]
        return turn

    def _own_pair(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives just these two. Their own merges are undone, the latest first: at no time may
        what then stands on the two sides of the boundary merge sooner than what was undone. Equal merges go from left to right."""
        if left[-1] + right[0] not in self._joined:
            return True
        turn, halves, score = self._turn, self._halves, self._score
        if left not in turn or right not in turn:
            return self._merged(left + right) == [left, right]
        before, too = math.inf, False
        while True:
            s = score.get(left + right)
            if s is not None and (-s < before or too and -s == before):
                return False
            too = turn[left] <= turn[right]
            if too:
                if right not in halves:
                    return True
                before, right = turn[right], halves[right][0]
            else:
                before, left = turn[left], halves[left][1]

    def _try_after(self, before: int, piece: str) -> int:
        """The id of a piece if it can follow the piece ``before``, else -1; remembered."""
        if self._tried >= _PAIRS:
            self._after.clear()
            self._tried = 0
        i = self._whole[piece]
        found = self._after[before][self._piece[i]] = i if self._own_pair(self._piece[before], piece) else -1
        self._tried += 1
        return found

    def _unit(self, unit: str) -> bytes:
        joined = self._joined
        if all(map(joined.__contains__, map(operator.add, unit, unit[1:]))):
            return b"".join(self.stream([unit]))
        parts, begin = [], 0
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in joined:
                parts.append(unit[begin:k])
                begin = k
        return b"".join(map(self._known.__getitem__, [*parts, unit[begin:]]))

    def stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids of a stream of text (spaces already :data:`SPACE`), given out as soon as they are final."""
        most, every, whole, after = self.longest, self._commit_every, self._whole, self._after
        text = ""  # what is not committed yet, after up to the longest piece's length of what is
        last: list[int] = [-1]  # by end in text: the last piece of that prefix, -1 for a character that is no piece
        sizes: list[int] = [0]  # and its length
        ways: list[dict[str, int]] = [whole]  # and what may follow it
        committed = 0
        for chunk in chunks:
            for at in range(0, len(chunk), every):
                begin = len(text)
                text += chunk[at : at + every]
                for end in range(begin + 1, len(text) + 1):
                    found, size = -1, 1
                    if text[end - 1] in whole:  # else it merges with nothing
                        for start in range(end - 1, max(end - most, 0) - 1, -1):
                            piece = text[start:end]
                            i = ways[start].get(piece)
                            if i is None:
                                if piece not in whole:
                                    continue
                                i = self._try_after(last[start], piece)
                            if i >= 0:
                                found, size = i, end - start
                                break
                    last.append(found)
                    sizes.append(size)
                    ways.append(whole if found < 0 else after[found])
                if len(text) - committed > most + every:
                    meet = self._meeting(sizes, committed)
                    yield self._given(text, last, sizes, committed, meet)
                    drop = max(0, min(meet, len(text) - most))
                    text, last, sizes, ways, committed = text[drop:], last[drop:], sizes[drop:], ways[drop:], meet - drop
        yield self._given(text, last, sizes, committed, len(text))

    def _meeting(self, sizes: list[int], committed: int) -> int:
        """The last boundary that the paths of all positions that can still be continued have in common."""
        end = len(sizes) - 1
        heads = set(range(max(committed, end - self.longest + 1), end + 1))
        while len(heads) > 1:
            head = max(heads)
            heads.remove(head)
            heads.add(head - sizes[head])
        return heads.pop()

    def _given(self, text: str, last: list[int], sizes: list[int], begin: int, end: int) -> bytes:
        out = []
        while end > begin:
            i = last[end]
            if i >= 0:
                out.append(self._packed[i])
            elif self._bytes:
                out.append(b"".join(self._packed[self._bytes[b]] for b in text[end - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(self._packed[self._unknown])
            end -= sizes[end]
        return b"".join(reversed(out))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers; none for an empty text."""
        if not text:
            return b""
        known, out = self._known, []
        for k, line in enumerate(text.split("\n") if self._lines else [text]):
            if k:
                out.append(known["\n"])
            if "  " in line or SPACE in line or line[-1:] == " " or not k and line[:1] == " ":
                out += map(known.__getitem__, _UNITS.findall((line if k else " " + line).replace(" ", SPACE)))
            elif line or not k:
                first, *words = line.split(" ")
                out.append(known[first if k else SPACE + first])
                out += [known[SPACE + w] for w in words]
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        if not ids:
            return ""
        raw = b"".join(map(self._text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``ids``: the SentencePiece ids of the whole text, as binary of
    little-endian unsigned 32-bit numbers. Null and empty texts have no ids; texts of any length are
    encoded in memory proportional to their ids; repeated rows are encoded one by one; a column named
    ``ids`` is replaced; an empty table stays empty."""

    kept = [c for c in docs.columns if c.lower() != "ids"]
    return with_computed(docs.select(*kept), "ids", BinaryType(), docs[text].cast("string"), lambda: codec(model).encode)


def decode_pieces(encoded: DataFrame, model: str, *, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` plus ``decoded``, the text of its ids: the text that was encoded,
    but for the character U+2581, which the model takes for a space. Null ids give the empty text; ids of any
    number are decoded whole; repeated rows one by one; a column named ``decoded`` is replaced; an empty table stays empty."""

    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    return with_computed(encoded.select(*kept), "decoded", StringType(), encoded[ids], lambda: codec(model).decode)
