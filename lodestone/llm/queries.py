"""The corpus queries of the driver contract: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, html, langid, lines, minhash, mixing, quality, tokens, urls, warc

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB: the words of a text.
_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=2, percent=80)


OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, w.doc_id) AS component_id,
       w.doc_id = coalesce(c.m, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(read(spark, sf_dir, "documents"), tokens.default_tokenizer(), end_id=1)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.kept_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE h.holder <> k.doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.holder IS NULL OR h.holder = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN h ON h.key = k.key GROUP BY k.doc_id
"""


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most_repeats=2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS target FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND target <> page_id THEN target END AS refers_to
FROM m
"""

def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _rules_sql() -> str:
    """DuckDB: the longest rule that fits (host, path), as a CASE over the rules from long to short."""
    cases = []
    for text, _ in sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, rest = text.partition("/")
        cases.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{text}'")
    return "CASE " + " ".join(cases) + " END"


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone say of every url."""
    found = urls.judged(read(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


_VERDICTS = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in urls.RULES) + " END"
URL_RULES_SQL = f"""
WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, {_rules_sql()} AS rule FROM h)
SELECT page_id, host, path, rule, {_VERDICTS} AS ruled FROM r
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the documents and their sources, and the words that the mix takes of each source, to a whole word."""
    taken = op4_mixing(spark, sf_dir)
    sources = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "source")
    rows = taken.join(sources, F.col("doc_id") == F.col("d"))
    return rows.groupBy("source").agg(F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"), F.sum("taken").alias("taken"))


MIX_TARGETS_SQL = f"""
WITH RECURSIVE w AS (SELECT source, sum(len({_WORDS.format("coalesce(text, '')")}))::BIGINT AS size FROM documents GROUP BY source),
s AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM w),
r AS (SELECT 0 AS step, source, size, weight, NULL::DOUBLE AS fixed, 1.5 * (SELECT sum(size) FROM s) AS owed, (SELECT sum(weight) FROM s) AS of FROM s
  UNION ALL SELECT step + 1, source, size, weight, f, owed - coalesce(sum(CASE WHEN fixed IS NULL THEN f END) OVER (), 0), sum(CASE WHEN f IS NULL THEN weight ELSE 0 END) OVER ()
  FROM (SELECT *, coalesce(fixed, CASE WHEN owed * weight / of > 2 * size THEN 2.0 * size END) AS f FROM r WHERE step < 40) x),
t AS (SELECT source, size, coalesce(fixed, owed * weight / of) AS target FROM r WHERE step = 40)
SELECT source, size, size AS source_size, round(target, 6) AS target, round(target)::BIGINT AS taken FROM t
"""


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts behind the rules and the base rules' verdict."""
    return op10_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) > 2),
d AS (SELECT doc_id, p FROM i QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
"""


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: Right for pages whose article is one <article> element and whose character references are &amp; and &quot;.
OP6_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<[^>]*>') AS parts FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.train(docs)).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {
    "op1_minhash": op1_minhash, "op2_token_output": op2_token_output, "op3_url_filters": op3_url_filters, "op4_mixing": op4_mixing, "op5_line_dedup": op5_line_dedup,
    "op6_html": op6_html, "op7_warc": op7_warc, "op8_language": op8_language, "op9_decontamination": op9_decontamination, "op10_quality": op10_quality,
    "url_rules": url_rules, "mix_targets": mix_targets, "quality_measures": quality_measures,
}
ORACLES = {
    "op1_minhash": OP1_SQL, "op5_line_dedup": OP5_SQL, "op6_html": OP6_SQL, "op7_warc": OP7_SQL, "url_rules": URL_RULES_SQL,
    "mix_targets": MIX_TARGETS_SQL, "quality_measures": QUALITY_SQL,
}
