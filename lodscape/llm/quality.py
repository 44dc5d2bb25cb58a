"""A quality classifier that reads documents as bags of passages (attention-based multiple-instance learning)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .common import Memo, give_back, kept_alone

#: Words in a passage; a shorter rest joins the passage before it.
PASSAGE_WORDS = 128
#: Labelled rows that are learned from at most (those with the least hashes of their ids).
SAMPLE_ROWS = 4_000
#: Rows of features that a document is learned from at most: neighbouring passages of longer ones are averaged into so many.
SAMPLE_PASSAGES = 32
#: Buckets that words are hashed to.
HASHED = 64
_CLASSES = 9
# Byte classes (other, lower, upper, digit, stop, other punctuation, symbol, shout or bar, beyond ASCII); 255 is not counted.
_CLASS = np.zeros(256, dtype=np.uint8)
for _bytes, _c in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b".,", 4), (b"'\"()-:;?/@_", 5), (b"#$%&*+<=>[]\\^`{}~", 6), (b"!|", 7), (range(192, 256), 8), (range(128, 192), 255)):
    for _b in _bytes:
        _CLASS[_b] = _c
FEATURES = _CLASSES * _CLASSES + 8 + HASHED


@kept_alone
def _buckets() -> Memo:
    return Memo(lambda w: zlib.crc32(w.lower()) % HASHED, most=100_000)


def passages_of(text: str | None) -> list[list[bytes]]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    cuts = list(range(0, len(words), PASSAGE_WORDS)) or [0]
    if len(cuts) > 1 and len(words) - cuts[-1] < PASSAGE_WORDS // 2:
        cuts.pop()
    return [words[a:b] for a, b in zip(cuts, [*cuts[1:], len(words)])]


def encode_passage(words: list[bytes]) -> np.ndarray:
    """How often each byte class follows each other, how varied, long and repetitive the words are, and which hashed words there are."""
    out = np.zeros(FEATURES, dtype=np.float32)
    if not words:
        return out
    c = _CLASS[np.frombuffer(b" ".join(words), dtype=np.uint8)]
    c = c[c != 255].astype(np.int64)
    if len(c) > 1:
        out[: _CLASSES * _CLASSES] = np.sqrt(np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES) / (len(c) - 1))
    n = len(words)
    distinct = len(set(words))
    pairs = list(zip(words, words[1:]))
    out[_CLASSES * _CLASSES : -HASHED] = (
        1.0,
        min(np.log1p(n) / 5, 2.0),
        distinct / n,
        len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        len(c) / n / 10,
        max(map(len, words)) / 50 if max(map(len, words)) < 500 else 10.0,
        distinct / n * (n >= 40),
    )
    out[-HASHED:] = np.sqrt(np.bincount(list(map(_buckets().__getitem__, words)), minlength=HASHED) / n)
    return out


def encode_document(text: str | None) -> np.ndarray:
    """A row of features for every passage of the whole text; one zero row for a text without a word."""
    return np.stack([encode_passage(p) for p in passages_of(text)])


def pooled(x: np.ndarray, most: int = SAMPLE_PASSAGES) -> np.ndarray:
    """The rows of a document, neighbours averaged so that ``most`` are left; all its passages take part."""
    if len(x) <= most:
        return x
    edges = np.arange(most) * len(x) // most
    return (np.add.reduceat(x, edges, axis=0) / np.diff(np.append(edges, len(x)))[:, None]).astype(np.float32)


@dataclass(frozen=True)
class PassageModel:
    """Passages x: z = tanh(x W + b); weights softmax over the document of (tanh(z V) * sigmoid(z U)) w; score sigmoid(sum(weight z) c + d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - self.mean) / self.scale
        z = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(z @ p["V"]), 1 / (1 + np.exp(-(z @ p["U"])))
        e = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        doc = np.add.reduceat(a[:, None] * z, starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(doc @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "z": z, "t": t, "g": g, "a": a, "doc": doc, "score": score, "sizes": sizes}

    def passage_score(self, x: np.ndarray) -> np.ndarray:
        """What each passage would give to the score if it had all the weight."""
        p = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"]) @ p["c"]

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, documents[:-1])])
        return self.forward(np.concatenate(documents).astype(np.float64), starts)["score"]


def _mixed(parts: list[np.ndarray], y: np.ndarray, model: PassageModel, r: np.random.Generator, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Up to n bags more, labelled 0: the passages of a document labelled 1, and among them that passage
    of a document labelled 0 which the model so far finds the worst."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return parts, y
    more = []
    for g, b in zip(r.choice(good, n), r.choice(bad, n)):
        worst = np.argmin(model.passage_score(parts[b])) if len(parts[b]) > 1 else 0
        more.append(np.insert(parts[g], r.integers(0, len(parts[g]) + 1), parts[b][worst], axis=0))
    return parts + more, np.append(y, np.zeros(n))


def fit(documents: list[np.ndarray], labels: np.ndarray, *, hidden: int = 24, attention: int = 12, steps: int = 900, batch: int = 192, mixed: float = 0.25, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> PassageModel:
    """The model learned from whole documents' labels by Adam; the same input gives the same model.

    Labelled documents are mostly good or bad throughout, which teaches no attention. So each batch also
    has a share ``mixed`` of bags in which a bad document's passages stand among a good one's: to call
    these bad, the weights have to find the bad passages.
    """
    r = np.random.default_rng(seed)
    flat = np.concatenate(documents).astype(np.float64)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 0.02
    shape = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "w": (attention,), "c": (hidden,), "d": ()}
    p = {k: r.normal(0, 1 / np.sqrt(max(s[0], 1)), s) if len(s) and k != "b" else np.zeros(s) for k, s in shape.items()}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    y = labels.astype(np.float64)
    for step in range(1, steps + 1):
        chosen = r.choice(len(documents), min(batch, len(documents)), replace=False)
        parts, own = _mixed([documents[i] for i in chosen], y[chosen], PassageModel(mean, scale, p), r, int(mixed * len(chosen)))
        starts = np.cumsum([0, *map(len, parts[:-1])])
        f = PassageModel(mean, scale, p).forward(np.concatenate(parts).astype(np.float64), starts)
        d_out = (f["score"] - own) / len(own)
        grad = {"c": f["doc"].T @ d_out, "d": d_out.sum()}
        d_doc = np.repeat(d_out[:, None] * p["c"], f["sizes"], axis=0)
        d_a = (d_doc * f["z"]).sum(axis=1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, starts), f["sizes"]))
        grad["w"] = (f["t"] * f["g"]).T @ d_e
        d_t = d_e[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        d_g = d_e[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["z"].T @ d_t, f["z"].T @ d_g
        d_z = (f["a"][:, None] * d_doc + d_t @ p["V"].T + d_g @ p["U"].T) * (1 - f["z"] ** 2)
        grad["W"], grad["b"] = f["x"].T @ d_z, d_z.sum(axis=0)
        for k in p:
            g = grad[k] + decay * p[k] * (k != "d")
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * min(1.0, 3 * (1 - step / (steps + 1))) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return PassageModel(mean, scale, p)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@F.pandas_udf(BinaryType())
def _encoded(texts: pd.Series) -> pd.Series:
    return pd.Series([pooled(encode_document(t)).tobytes() for t in texts], dtype="object")


def learn_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> PassageModel | None:
    """The model learned from the labelled rows of ``docs`` that are not held out.

    At most ``sample_rows`` labels are used, those with the least hash of their id, and at most
    :data:`SAMPLE_PASSAGES` rows of features for each of these documents, so what comes to the driver
    is bounded whatever the number and length of texts. Labels that are null, or 0 and 1 for the same
    id, are left out; of rows that repeat an id the least text counts; null texts count as empty. None
    if there are no labels of both kinds.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.min(label).alias("_y"), F.max(label).alias("_z"))
        .where("_y = _z")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_rows)
        .select("_id", "_y")
    )
    chosen = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).join(F.broadcast(known), "_id")
    chosen = chosen.groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text"))
    rows = sorted(chosen.select("_id", "_y", _encoded("_text").alias("x")).collect(), key=lambda r: r["_id"])
    y = np.array([r["_y"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return fit([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows], y)


def score_quality(docs: DataFrame, model: PassageModel | None, *, least: float = 0.3, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``score`` (0 to 1, of the whole text alone) and ``predicted`` (1 from ``least`` on).

    Null and empty texts are one passage without a word and get that score; without a model all
    scores are 0.5; repeated rows are scored one by one; columns named like the results are replaced;
    an empty table stays empty.
    """

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list[float] = []
            for i in range(0, len(b), 512):
                part = [encode_document(t) for t in b.iloc[i : i + 512]]
                out.extend(model.score(part).tolist())
            yield pd.Series(out, dtype="float64")
        give_back()

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    score = F.lit(0.5) if model is None else F.pandas_udf(scored, DoubleType())(docs[text].cast("string"))
    out = docs.select(*[docs[c] for c in kept], score.alias("score"))
    return out.select(*kept, "score", (F.col("score") >= least).cast("int").alias("predicted"))
