"""The corpus operators' queries: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, html_text, licenses, media, packing, pii, quality, rules, sentencepieces, simhash, substrings, url_rules
from .common import public_vocabulary, table, written

# The rules of the url query.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.apply_url_rules(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.token_pieces(docs, public_vocabulary("word_bpe_49k.json"))
    pieces = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "piece-digests")
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text")))


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_vocabulary("piece_bpe_32k.model")
    encoded = sentencepieces.encode_pieces(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    decoded = sentencepieces.decode_pieces(encoded, model)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("decoded").cast("long").alias("n_chars_decoded"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.coalesce(F.col("decoded") == F.translate("text", sentencepieces.SPACE, " "), F.col("decoded") == "").alias("round_trip"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents", "text", "lang"), least=100, longest=5, top=2000)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    aligned = alignment.align_texts(docs, public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    blocks = alignment.link_blocks(aligned.select("doc_id", "n_a", "n_b", "n_groups", digest, "links"))
    scored = alignment.link_scores(blocks, alignment.link_counts(blocks))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filters, op2_html_text, op3_substring_dedup, op4_simhash, op5_packing, op6_quality_classifier, op7_pii, op8_sentencepieces, op9_quality_rules, op10_media, op11_collocations, op12_alignment, op13_licenses]
    return {f.__name__: f for f in found}


_URL_SQL = """
WITH r(verdict, host, path, rule) AS (VALUES {rules}),
p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p
)
SELECT page_id, q.host, q.path, max_by(r.rule, length(r.rule)) AS rule, coalesce(max_by(r.verdict, length(r.rule)), 'allow') AS verdict
FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
GROUP BY page_id, q.host, q.path
"""


_PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, string_split_regex(piece, '[\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)
),
w AS (SELECT lang, list_filter(ws, lambda x: x <> '') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
  GROUP BY 1, 2, 3 HAVING count(*) >= 100
),
inside AS (
  SELECT DISTINCT lang, unnest([array_to_string(string_split(phrase, ' ')[1:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:k], ' ')]) AS phrase, f FROM f WHERE k > 2
),
kept AS (SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.phrase = f.phrase AND i.f = f.f)),
cuts AS (SELECT *, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS first, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, n.n, c.cut, CAST(CAST(1000 AS HUGEINT) * c.f * n.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN n ON n.lang = c.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{h}', '/{p}', '{h}/{p}')" for v, rule in URL_RULES for h, _, p in [rule.partition("/")])
    return {"op1_url_filters": _URL_SQL.format(rules=rules), "op11_collocations": _PHRASES_SQL}
