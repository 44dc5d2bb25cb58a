"""English stems for text queries, by the published Snowball rules for English (Porter2).

Only words of ASCII letters are stemmed; others stay as they are. Words of a query and of the texts
must be stemmed alike, which :data:`ENGLISH` does for :func:`lodscape.functions.predicates.text_matches`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values of the published rules.
_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_REGION = re.compile(f"[{_V}][^{_V}]")
_PLAIN = re.compile("[a-z]+")


def _regions(w: str) -> tuple[int, int]:
    """Where the parts after the first and the second vowel-consonant pair begin."""
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _ends_short(w: str) -> bool:
    return len(w) == 2 and w[0] in _V and w[1] not in _V or len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def _swap(w: str, table: dict[str, str], r1: int) -> tuple[str, str | None]:
    """The word with its longest ending of a table exchanged, if that ending lies in a region, and the ending."""
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            return (w[: -len(end)] + table[end], end) if len(w) - len(end) >= r1 else (w, end)
    return w, None


def stem(word: str) -> str:
    if len(word) < 3 or not _PLAIN.fullmatch(word):
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _UNCHANGED:
        return word
    w = re.sub(f"(?<=[{_V}])y|^y", "Y", word)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in _UNCHANGED:
        return w
    # past and continuous forms
    m = re.search("(eedly|ingly|edly|eed|ing|ed)$", w)
    if m and m[0].startswith("eed"):
        w = w[: m.start()] + "ee" if m.start() >= r1 else w
    elif m and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # longer endings
    done, end = _swap(w, _STEP2, r1)
    if end:
        w = done
    elif w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
        w = w[:-1]
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
        w = w[:-2]
    done, end = _swap(w, _STEP3, r1)
    if end:
        w = done
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    for end in sorted(_STEP4 + ("ion",), key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for b in words:
        for w in {w for row in b if row is not None for w in row}.difference(known):
            known[w] = stem(w)
        yield pd.Series([None if row is None else [known[w] for w in row] for row in b])
        if len(known) > 200_000:
            known.clear()


def stems(words: Column) -> Column:
    """Stems of an array column of words; each distinct word of a batch is stemmed once."""
    return _stems(words)


#: For ``text_matches(..., stem=ENGLISH)``.
ENGLISH = (stem, stems)
