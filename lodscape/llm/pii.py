"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is Spark SQL expressions: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, written so that Java's matcher reads each character a bounded
# number of times (possessive repeats; \G and look-behind let a match begin only where a run begins
# or the match before has ended). They match just what the plain forms match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The further proposals of the scorer.
PROPOSED = {
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# What a text must hold for a pattern to be tried at all.
HINT = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9][\x20-]?[0-9]",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "national_id": r"[0-9]{3}-[0-9]{2}-",
    "local_phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]",
}
# Words near a span that raise or lower its score.
CONTEXT = {
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|carte|karte|tarjeta)\b",
    "phone": r"(?i)\b(tel|phone|mobile|call|fax|telefon|anruf|t[eé]l[eé]phone|tel[eé]fono|llame)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b",
    "national_id": r"(?i)\b(ssn|social security|tax id|identity|ausweis|identit[eé]|dni)\b",
}
AGAINST = r"(?i)\b(isbn|issn|version|order|invoice|serial|part no)\b"


@dataclass(frozen=True)
class Scoring:
    """A proposal's score is start + confirmed (its checksum or length holds) + nearby (a context word
    stands within ``reach`` characters) - against (a contrary word does); it counts from ``least`` on."""

    start: float = 0.3
    confirmed: float = 0.4
    nearby: float = 0.3
    against: float = 0.2
    least: float = 0.6
    reach: int = 48


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
_NUMBERS = "cast(array() as array<bigint>)"
#: Characters of a block that texts are cut into where spans are replaced.
_BLOCK = 1024


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which a name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(values: str, both: str) -> str:
    """SQL: for each of an array of numbers, what ``both`` (of ``p`` and ``q``) makes of all before it, 0 for the first.
    The array is cut into about as many parts as a part has numbers, so that the work grows with the 1.5th power of their number."""
    total = f"aggregate(part, 0L, (p, q) -> {both})"
    offsets = f"aggregate(transform(parts, part -> {total}), named_struct('p', 0L, 'out', {_NUMBERS}), (a, q) -> {_let('p', 'a.p', f"named_struct('p', {both}, 'out', concat(a.out, array(p)))")}, a -> a.out)"
    each = f"aggregate(part, named_struct('p', o, 'out', {_NUMBERS}), (a, q) -> {_let('p', 'a.p', f"named_struct('p', {both}, 'out', concat(a.out, array(p)))")}, a -> a.out)"
    return _let(
        "n",
        values,
        f"case when size(n) = 0 then {_NUMBERS} else "
        + _let("wide", "greatest(64, int(sqrt(size(n))))", _let("parts", "transform(sequence(1, size(n), wide), k -> slice(n, k, wide))", f"flatten(zip_with(parts, {offsets}, (part, o) -> {each}))"))
        + " end",
    )


def _searched(text: str, kind: str, pattern: str, hint: str, reach: int) -> str:
    """SQL: all leftmost non-overlapping matches, with their code points and up to ``reach`` characters before and after each."""
    q, near = _quoted(pattern), reach // 2 + 1  # so many matches, of two characters or more, are beyond reach
    empty = "cast(array() as array<struct<kind:string,start:bigint,end:bigint,text:string,before:string,after:string>>)"
    before = f"concat(array_join(flatten(zip_with(slice(tails, low, i - low), slice(m, low, i - low), (x, y) -> array(x, y))), ''), element_at(tails, i))"
    after = f"concat(element_at(heads, i + 1), array_join(flatten(zip_with(slice(m, i + 1, {near}), slice(heads, i + 2, {near}), (x, y) -> array(x, y))), ''))"
    found = (
        f"transform(sequence(1, size(m)), i -> named_struct('kind', '{kind}', 'start', element_at(starts, i), 'end', element_at(starts, i) + length(element_at(m, i)), 'text', element_at(m, i), "
        f"'before', {_let('low', f'greatest(1, i - {near})', f'right({before}, {reach})')}, 'after', left({after}, {reach})))"
    )
    starts = f"zip_with({_before('zip_with(slice(g, 1, size(m)), m, (x, y) -> bigint(length(x) + length(y)))', 'p + q')}, slice(g, 1, size(m)), (x, y) -> x + length(y))"
    with_gaps = _let("g", f"split({text}, '{q}', -1)", _let("starts", starts, _let("tails", f"transform(g, x -> right(x, {reach}))", _let("heads", f"transform(g, x -> left(x, {reach}))", found))))
    return f"case when {text} rlike '{_quoted(hint)}' then {_let('m', f"regexp_extract_all({text}, '{q}', 0)", f'case when size(m) = 0 then {empty} else {with_gaps} end')} else {empty} end"


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def luhn(text: str) -> str:
    """SQL: the digits of text pass the Luhn check."""
    d = f"split(reverse({_digits(text)}), '')"
    return (
        f"aggregate(sequence(1, length({_digits(text)})), 0, (s, i) -> s + case when i % 2 = 1 then int(element_at({d}, i)) "
        f"when int(element_at({d}, i)) >= 5 then 2 * int(element_at({d}, i)) - 9 else 2 * int(element_at({d}, i)) end) % 10 = 0"
    )


def mod97(text: str) -> str:
    """SQL: text, as an account number, leaves 1 when divided by 97 (its first four characters moved to the end, A=10 ... Z=35)."""
    c = f"replace({text}, ' ', '')"
    return (
        f"aggregate(split(concat(substring({c}, 5), substring({c}, 1, 4)), ''), 0, (r, x) -> "
        f"case when x rlike '[0-9]' then (r * 10 + int(x)) % 97 when x rlike '[A-Z]' then (r * 100 + ascii(x) - 55) % 97 else r end) = 1"
    )


_VALID = {
    "email": "true",
    "ip": r"x.text rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": f"case when length({_digits('x.text')}) between 16 and 19 then {luhn('x.text')} else false end",
    "phone": f"length({_digits('x.text')}) between 8 and 15",
    "iban": f"case when length(replace(x.text, ' ', '')) between 15 and 34 then {mod97('x.text')} else false end",
    "national_id": "not (x.text rlike '^(000|666|9)|-00-|-0000$')",
    "local_phone": "true",
}


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_personal_data(docs: DataFrame, *, text: str = "text", scoring: Scoring = Scoring()) -> DataFrame:
    """All columns of ``docs`` plus ``pii_base`` and ``pii`` (kind, start, end, text, score; code points, end exclusive).

    ``pii_base``: valid matches of the base patterns (email, ip, card, phone), by kind, then start.
    ``pii``: these with score 1, and further proposals: cards in one or four groups and numbers with a
    plus inside base matches that fail, account numbers (mod-97), and, only where a context word
    stands near, national ids and phone numbers without a plus outside of base matches of phones.

    Null texts count as empty and give empty arrays; texts of any length are searched whole, in time
    that grows with the 1.5th power of the number of matches at most; repeated rows are searched one by one; columns of
    these two names are replaced, all others kept; an empty table stays empty. Spans of one kind
    never overlap, so there are no ties but spans of different kinds.
    """
    s = scoring
    kept = [c for c in docs.columns if c.lower() not in ("pii", "pii_base")]
    own = docs.select(F.struct(*[docs[c] for c in kept]).alias("_lodscape_row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    found = own.select("_lodscape_row", "t", *[F.expr(_searched("t", k, p, HINT[k], s.reach)).alias(f"b_{k}") for k, p in BASE.items()])

    def counted(k: str, before: str, after: str, at: str) -> str:
        kind = "phone" if k == "local_phone" else k
        near, later = f"right({before}, {s.reach})", f"left({after}, {s.reach})"
        word, against = _quoted(CONTEXT[kind]), _quoted(AGAINST)
        sure = 0.0 if k in ("national_id", "local_phone") else s.confirmed
        score = f"{s.start}D + {sure}D + case when {near} rlike '{word}' or {later} rlike '{word}' then {s.nearby}D else 0D end - case when {near} rlike '{against}' then {s.against}D else 0D end"
        return f"named_struct('kind', '{kind}', 'start', {at} + x.start, 'end', {at} + x.end, 'text', x.text, 'score', {score})"

    def proposals(where: str, k: str, before: str = "x.before", after: str = "x.after", at: str = "0L") -> str:
        valid = f"filter({_searched(where, k, PROPOSED[k], HINT[k], s.reach)}, x -> {_VALID[k]})"
        return f"filter(transform({valid}, x -> {counted(k, before, after, at)}), x -> x.score >= {s.least}D)"

    within = lambda k: f"""flatten(transform(filter(b_{k}, x -> not ({_VALID[k]})), b -> {_let("whole", "b.text", proposals("whole", k, "concat(b.before, x.before)", "concat(x.after, b.after)", "b.start"))}))"""
    # the gaps between base matches of phones, each with where it begins and what stands around it
    gaps = f"""zip_with(split(t, '{_quoted(BASE["phone"])}', -1), concat(array(cast(null as struct<end:bigint,before:string>)), transform(b_phone, b -> named_struct('end', b.end, 'before', concat(b.before, b.text)))),
        (gap, b) -> named_struct('gap', gap, 'at', coalesce(b.end, 0L), 'before', coalesce(b.before, '')))"""
    gaps = f"case when t rlike '{_quoted(HINT['local_phone'])}' then zip_with({gaps}, transform(b_phone, b -> concat(b.text, b.after)), (gap, a) -> named_struct('gap', gap.gap, 'at', gap.at, 'before', gap.before, 'after', coalesce(a, ''))) end"
    outside = f"""coalesce(flatten(transform({gaps}, b -> {_let("whole", "b.gap", proposals("whole", "local_phone", "concat(b.before, x.before)", "concat(x.after, b.after)", "b.at"))})), cast(array() as {_SPANS}))"""
    full = lambda k: f"transform(filter(b_{k}, x -> {_VALID[k]}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'text', x.text, 'score', 1.0D))"
    more = {"card": within("card"), "phone": within("phone"), "local": outside, "iban": proposals("t", "iban"), "national_id": proposals("t", "national_id")}
    spans = found.select("_lodscape_row", *[F.expr(full(k)).alias(f"v_{k}") for k in BASE], *[F.expr(e).alias(f"s_{k}") for k, e in more.items()])
    by_start = "(a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 else 0 end"
    parts = ["v_email", "v_ip", f"array_sort(concat(v_card, s_card), {by_start})", f"array_sort(concat(v_phone, s_phone, s_local), {by_start})", "s_iban", "s_national_id"]
    return spans.select("_lodscape_row.*", F.expr(f"concat({', '.join(f'v_{k}' for k in BASE)})").alias("pii_base"), F.expr(f"concat({', '.join(parts)})").alias("pii"))


def personal_data_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their spans, and all spans as text."""
    counts = [F.expr(f"cast(size(filter(pii_base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("pii_base"), 256).alias("base_sha256"), _joined("pii").alias("spans"))


def mask_personal_data(docs: DataFrame, *, text: str = "text", scoring: Scoring = Scoring()) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in angle brackets;
    overlapping spans are merged and named by the first (the longer of two that begin together).

    Null texts stay null, texts without spans as they are; texts of any length are masked whole; rows, repeated
    ones too, and all other columns, whatever their names, are kept; an empty table stays empty.
    """
    by_place = "(a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.end > b.end then -1 when a.end < b.end then 1 else 0 end"
    row = docs.select(F.struct(*docs.columns).alias("_lodscape_doc"), docs[text].cast("string").alias("t"))
    found = find_personal_data(row, text="t", scoring=scoring).select("_lodscape_doc", "t", F.expr(f"array_sort(pii, {by_place})").alias("spans"))
    found = found.select("*", F.expr(_before("transform(spans, x -> x.end)", "greatest(p, q)")).alias("done"), F.when(F.size("spans") > 0, F.expr(f"regexp_extract_all(t, '(?s).{{1,{_BLOCK}}}', 0)")).alias("blocks"))
    piece = lambda a, b: f"case when {b} > {a} then substring(array_join(slice(blocks, int({a} div {_BLOCK}) + 1, int(({b} - 1) div {_BLOCK} - {a} div {_BLOCK}) + 1), ''), int({a} % {_BLOCK}) + 1, int({b} - {a})) else '' end"
    masked = f"""concat(array_join(zip_with(spans, done, (x, d) -> case when x.start >= d then concat({piece("d", "x.start")}, '<', upper(x.kind), '>') else '' end), ''),
        {_let("z", "array_max(transform(spans, x -> x.end))", piece("z", "length(t)"))})"""
    masked_text = F.when(F.size("spans") > 0, F.expr(masked)).otherwise(F.col("t"))
    return found.select("_lodscape_doc", masked_text.alias("t")).select(*[F.col("t").alias(c) if c == text else F.col("_lodscape_doc")[c].alias(c) for c in docs.columns])
