"""Quality rules: counts of a text, and how far its characters and common words are from those of a language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import written

# Common words of the languages that have a reference.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on as be with by this are or at from an a not have".split(),
    "de": "der die das und in von den mit im des auf ist sich nicht ein eine dem zu als auch es an".split(),
    "fr": "le la les de des du et un une en que qui est pour dans par sur au pas ce il plus".split(),
    "es": "el la los las de del que y en un una por con para su se al es no lo como más".split(),
}
VOCABULARY = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
# Byte classes: lower, upper, digit, white space, stop, other punctuation, symbol, beyond ASCII, control; 255 continues a character.
CLASSES = 9
_CLASS = np.full(256, 8, dtype=np.uint8)
for _bytes, _c in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t\n\v\f\r", 3), (b".,", 4), (b"!\"'()-/:;?@_", 5), (b"#$%&*+<=>[\\]^`{|}~", 6), (range(192, 256), 7), (range(128, 192), 255)):
    for _b in _bytes:
        _CLASS[_b] = _c
_SPACES = list(b" \t\n\v\f\r")
_SYMBOLS = list(b"#*$%&|<>")
_WINDOW = 8
_FORMS = [[v.encode() for x in (w, w.capitalize()) for v in (x, x + ",", x + ".")] for w in VOCABULARY]


def repeated_words(ids: np.ndarray, window: int = _WINDOW) -> int:
    """How many words lie in windows of so many words that the text holds twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(counts[inverse] > 1)
    if not len(maybe):
        return 0
    windows = list(map(bytes, np.lib.stride_tricks.sliding_window_view(ids, window)[maybe]))
    seen = Counter(windows)
    starts = maybe[[seen[w] > 1 for w in windows]]
    if not len(starts):
        return 0
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def profile_of(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words (the last: all others)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n_chars = int(counts.sum() - counts[128:192].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    order: dict[bytes, int] = {}
    words = raw.split()
    ids = np.fromiter((order.setdefault(w, len(order)) for w in words), dtype=np.int64, count=len(words))
    repeats = repeated_words(ids) if len(order) < len(words) else 0
    often = np.bincount(ids, minlength=len(order)) if len(words) else ()
    common = [sum(int(often[order[f]]) for f in forms if f in order) for forms in _FORMS]
    classes = np.bincount(_CLASS, weights=counts, minlength=256)[:CLASSES].astype(int).tolist()
    return (
        len(words),
        n_chars - int(counts[_SPACES].sum()),
        int(counts[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeats,
        classes,
        [*common, len(words) - sum(common)],
    )


_PROFILE = StructType(
    [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField(c, ArrayType(LongType())) for c in ("classes", "common")]
)


@F.pandas_udf(_PROFILE)
def _profiles(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([profile_of(t) for t in texts], columns=[f.name for f in _PROFILE])


def text_profiles(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``_lodscape_profile``, the counts and histograms of :func:`profile_of`."""
    return docs.select(*docs.columns, _profiles(docs[text].cast("string")).alias("_lodscape_profile"))


def language_references(profiles: DataFrame, *, lang: str = "lang") -> list[tuple[str, list[float], list[float]]]:
    """(language, character classes, common words), as shares, over all documents of each language in
    :data:`COMMON_WORDS`; a document counts by its shares, so that long ones don't outweigh the others.
    What comes to the driver is one row for each of these languages."""
    p = F.col("_lodscape_profile")
    shares = lambda c, n: [F.avg(F.element_at(p[c], i + 1) / F.greatest(F.aggregate(p[c], F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))) for i in range(n)]
    rows = (
        profiles.where(F.col(lang).isin(*COMMON_WORDS) & (p["n_words"] > 0))
        .groupBy(F.col(lang).alias("_lang"))
        .agg(F.array(*shares("classes", CLASSES)).alias("c"), F.array(*shares("common", len(VOCABULARY) + 1)).alias("w"))
        .collect()
    )
    return [(r["_lang"], list(r["c"]), list(r["w"])) for r in sorted(rows, key=lambda r: r["_lang"])]


def jensen_shannon(counts: np.ndarray, reference: list[float]) -> np.ndarray:
    """The square root of the Jensen-Shannon divergence (base 2) of each row of counts and fixed shares; 0 for no counts."""
    total = counts.sum(axis=1, keepdims=True)
    p, q = counts / np.maximum(total, 1), np.asarray(reference, dtype=np.float64)[None, :] / (sum(reference) or 1.0)
    part = lambda a, b: np.where(a > 0, a * np.log2(2 * a / np.where(a > 0, a + b, 1.0), where=a > 0, out=np.zeros(np.broadcast_shapes(a.shape, b.shape))), 0.0)
    both = part(p, q) + part(np.broadcast_to(q, p.shape), p)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(both.sum(axis=1) / 2, 0.0)), 0.0)


def _nearest(references: list[list[float]]) -> Callable[[Column], Column]:
    """Of a column of counts, the distance to the nearest of some references; 0 if there are none."""
    if not references:
        return lambda c: F.lit(0.0)

    def nearest(counts: pd.Series) -> pd.Series:
        rows = np.stack(counts.to_numpy()).astype(np.float64) if len(counts) else np.zeros((0, len(references[0])))
        return pd.Series(np.min([jensen_shannon(rows, r) for r in references], axis=0))

    nearest.__annotations__ = {"counts": pd.Series, "return": pd.Series}
    return F.pandas_udf(nearest, DoubleType())


def judge_quality(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", most_classes: float = 0.27, most_words: float = 0.40, least_chars: int = 200, least_words: int = 60
) -> DataFrame:
    """All columns of ``docs`` plus the counts, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    A document fails the base rules with under 20 words, or if over 30 % of its words lie in repeated
    windows of 8. Otherwise it is kept unless its character classes are further than ``most_classes``,
    or its common words further than ``most_words``, from those of every language that has a
    reference (Jensen-Shannon distance, 0 to 1). Texts under ``least_chars`` characters in words, or
    ``least_words`` words, say too little for the one or the other and have distance 0.

    References come from all documents of each language. Null texts count as empty; a null or unknown
    language is judged like the others and adds to no reference; without any reference distances are
    0; repeated rows are judged one by one; texts of any length are counted whole; columns named like
    the results are replaced, all others kept; a distance just at a limit is kept; an empty table stays empty.
    """
    numbers = [f.name for f in _PROFILE if f.name not in ("classes", "common")]
    ours = (*numbers, "class_distance", "word_distance", "base_failed", "kept")
    kept = [c for c in docs.columns if c.lower() not in ours]
    profiles = written(text_profiles(docs.select(*[docs[c] for c in kept]), text=text), "profiles")
    references = language_references(profiles, lang=lang)
    classes, common = (_nearest([r[k] for r in references])(F.col(f"_lodscape_profile.{c}")) for k, c in ((1, "classes"), (2, "common")))
    n = F.col("n_words")
    out = profiles.select(*kept, *[F.col(f"_lodscape_profile.{c}").alias(c) for c in numbers], classes.alias("class_distance"), common.alias("word_distance"))
    out = out.withColumns(
        {
            "class_distance": F.when(F.col("word_chars") >= least_chars, F.col("class_distance")).otherwise(0.0),
            "word_distance": F.when(n >= least_words, F.col("word_distance")).otherwise(0.0),
            "base_failed": (n < 20) | (100 * F.col("n_repeat_words") > 30 * n),
        }
    )
    fits = (F.col("class_distance") <= most_classes) & (F.col("word_distance") <= most_words)
    return out.withColumn("kept", ~F.col("base_failed") & fits)
