"""The registered queries opN_<name>, each with the DuckDB statement of the same rows where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontam import contamination
from .ftrl_quality import quality
from .htmldiff import main_text
from .linededup import kept_digests
from .minhash import near_duplicates
from .packing import pack
from .quality_rules import quality_rules
from .secret_scan import scan_secrets
from .toxicity import toxicity
from .urlfilter import filter_urls

#: Lower-cases A-Z alone, as the contracts say.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents at a similarity of 0.85 of 5-word shingle sets."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT i, j FROM p UNION SELECT j, i FROM p),
r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT i, min(j) AS component_id FROM r GROUP BY i) c ON c.i = s.doc_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and the divergence of character classes and common words from language references."""
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _op2_sql() -> str:
    from . import quality_rules as q

    stop = re.escape(q.STOP).replace("'", "''")
    kinds = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": stop, "beyond": r"\x{80}-\x{10FFFF}"}
    length = lambda keep: f"length(regexp_replace(t, '[^{keep}]', '', 'g'))"
    parts = {k: length(v) for k, v in kinds.items()}
    parts["symbol"] = "length(t) - " + " - ".join(parts.values())
    words = ", ".join(f"'{w}'" for w in sorted({w for x in q.COMMON_WORDS.values() for w in x.split()}))
    langs = ", ".join(f"'{x}'" for x in q.COMMON_WORDS)
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM d WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS chars FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
cls AS (SELECT doc_id, lang, 'class' AS part, u.k AS k, CAST(u.n AS DOUBLE) AS n FROM (SELECT doc_id, lang, unnest(list_transform(range(0, {len(q.CLASSES)}), lambda i: {{'k': list_extract(ks, i + 1), 'n': list_extract(ns, i + 1)}})) AS u FROM (SELECT doc_id, lang, [{", ".join(f"'{c}'" for c in q.CLASSES)}] AS ks, [{", ".join(parts[c] for c in q.CLASSES)}] AS ns FROM d))),
w AS (SELECT doc_id, lang, translate(unnest(ws), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM d),
wk AS (SELECT doc_id, lang, CASE WHEN w IN ({words}) THEN w WHEN regexp_matches(w, '[{stop}]$') AND w[1:length(w) - 1] IN ({words}) THEN w[1:length(w) - 1] ELSE '' END AS k FROM w),
wrd AS (SELECT doc_id, lang, 'word' AS part, k, CAST(count(*) AS DOUBLE) AS n FROM wk GROUP BY doc_id, lang, k),
h AS (SELECT * FROM cls UNION ALL SELECT * FROM wrd),
refs AS (SELECT lang AS ref, part, k, sum(n) AS n FROM h WHERE lang IN ({langs}) GROUP BY lang, part, k),
rp AS (SELECT ref, part, k, n / sum(n) OVER (PARTITION BY ref, part) AS q FROM refs),
hp AS (SELECT doc_id, part, k, n / nullif(sum(n) OVER (PARTITION BY doc_id, part), 0) AS p FROM h),
keys AS (SELECT DISTINCT ref, part, k FROM rp UNION SELECT DISTINCT ref, hp.part, hp.k FROM hp, (SELECT DISTINCT ref FROM rp)),
docs AS (SELECT DISTINCT doc_id, part FROM hp WHERE p IS NOT NULL),
js AS (SELECT docs.doc_id, keys.ref, docs.part, sqrt(greatest(0, least(1, sum({half('coalesce(hp.p, 0)', 'coalesce(rp.q, 0)')} + {half('coalesce(rp.q, 0)', 'coalesce(hp.p, 0)')}) / 2))) AS dist
  FROM docs JOIN keys USING (part) LEFT JOIN rp ON rp.ref = keys.ref AND rp.part = keys.part AND rp.k = keys.k LEFT JOIN hp ON hp.doc_id = docs.doc_id AND hp.part = keys.part AND hp.k = keys.k GROUP BY docs.doc_id, keys.ref, docs.part),
two AS (SELECT doc_id, ref, coalesce(max(dist) FILTER (part = 'class'), 0) AS c, coalesce(max(dist) FILTER (part = 'word'), 0) AS w FROM js GROUP BY doc_id, ref),
near AS (SELECT doc_id, arg_min(c, c + w) AS c, arg_min(w, c + w) AS w FROM two GROUP BY doc_id),
v AS (SELECT base.*, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, chars >= {q.GUARD_CHARS} AND n_words >= {q.GUARD_WORDS}
  AND (c > {q.MAX_CLASS_DISTANCE} + {q.CLASS_SLACK} / sqrt(n_words) OR w > {q.MAX_WORD_DISTANCE} + {q.WORD_SLACK} / sqrt(n_words)) AS far FROM base LEFT JOIN near USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, FALSE) AS kept FROM v
"""


OP2_SQL = _op2_sql()


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark passages in them."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM v),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size),
h AS (SELECT dw.doc_id, dw.i, dw.size, item_id FROM dw JOIN win ON win.size = dw.size AND win.w = array_to_string(dw.ws[dw.i:dw.i + dw.size - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed along a space-filling curve."""
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs."""
    return filter_urls(read_table(spark, sf_dir, "pages"))


# Own rules and, for pages without one, the decision of the group that canonical links and refreshes make.
OP5_SQL = r"""
WITH RECURSIVE
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
refs AS (SELECT url, unnest([regexp_extract(html, '<link[^>]*rel\s*=\s*["'']?canonical[^>]*href\s*=\s*["'']([^"'']*)["'']', 1, 'i'),
    regexp_extract(html, '<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*content\s*=\s*["'']\s*[0-9.]+\s*[;,]\s*url\s*=\s*([^"''>\s]+)', 1, 'i')]) AS ref FROM pages),
edges AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS u, regexp_replace(ref, '#.*$', '') AS v FROM refs WHERE ref LIKE '%://%' AND url LIKE '%://%'),
urls AS (SELECT DISTINCT regexp_replace(coalesce(url, ''), '#.*$', '') AS a FROM pages UNION SELECT v FROM edges),
reach AS (SELECT a AS i, a AS j FROM urls UNION SELECT r.i, e.v FROM reach r JOIN (SELECT u, v FROM edges UNION SELECT v, u FROM edges) e ON r.j = e.u),
parts AS (SELECT DISTINCT a, CASE WHEN contains(a, '://') THEN translate(regexp_extract(substr(a, instr(a, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(a, '://') THEN regexp_replace(regexp_replace(substr(a, instr(a, '://') + 3), '^[^/?#]*', ''), '[?#].*$', '') ELSE '' END AS path FROM urls),
own AS (SELECT a, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
    FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY a, host, path),
grp AS (SELECT i, bool_or(verdict = 'allow') AS any_allow, bool_or(verdict = 'block') AS any_block FROM reach JOIN own ON own.a = reach.j WHERE i <> '' GROUP BY i)
SELECT p.page_id, own.host, own.path, own.rule,
  coalesce(own.verdict, CASE WHEN grp.any_block AND NOT coalesce(grp.any_allow, FALSE) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p JOIN own ON own.a = regexp_replace(coalesce(p.url, ''), '#.*$', '') LEFT JOIN grp ON grp.i = own.a
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by scaled character n-grams."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat, as digests."""
    return kept_digests(read_table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM l),
k AS (SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (d.key IS NOT NULL AND k.doc_id <> keeper) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (d.key IS NULL OR k.doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN d ON k.key = d.key GROUP BY k.doc_id
"""


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(read_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, found through a trigram index."""
    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by a word n-gram classifier trained with FTRL steps."""
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_minhash_dedup, op2_quality_rules, op3_decontamination, op4_curve_packing, op5_url_filter, op6_toxicity, op7_line_dedup, op8_html_extraction, op9_secret_scan, op10_quality_classifier)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op2_quality_rules": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_url_filter": OP5_SQL, "op7_line_dedup": OP7_SQL}
