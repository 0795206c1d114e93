"""Proxy texts: documents stand in for queries, their sources for families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key, normal, phrase
from ..operators import families as Y
from ..operators.sampling import split_exact
from ..sources.pairs import table
from .base import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

ARTIFACTS = r"(?i)([#$%&*]{3} [^ ]+[#$%&*]{3} [^ ]+[#$%&*]{3}|\b(spam|lorem ipsum)\b)"

_S = "[ \\t\\n\\x0B\\f\\r]+"
NORMAL = f"trim(regexp_replace(regexp_replace(regexp_replace({{t}}, '^{_S}|{_S}$', '', 'g'), '^\"+|\"+$', '', 'g'), '{_S}', ' ', 'g'))"
KEY = f"lower(trim(regexp_replace({{t}}, '{_S}', ' ', 'g')))"
WORDS = "CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END"
PHRASED = f"""CASE WHEN p <> '' AND len(w) <= 6 AND length(p) <= 48 AND NOT (len(w) > 3 AND len(list_distinct(w)) <= greatest(1, len(w) // 3)) THEN p END AS phrase
FROM (SELECT *, string_split(p, ' ') AS w FROM (SELECT *, regexp_replace(trim(regexp_replace(replace(lower(part), '_', ' '), '{_S}', ' ', 'g')), '^[ .,:;/-]+|[ .,:;/-]+$', '', 'g') AS p FROM parts))"""
PARTS = "parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[,;/|]+')) AS part FROM documents)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """family, its order, pos and query of every document."""
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("family"), F.substring("source", 4, 9).cast("int").alias("family_order"), F.col("doc_id").alias("pos"), F.col("text").alias("query"), "lang")


DOCS = "docs AS (SELECT doc_id, source AS family, CAST(substr(source, 4) AS INT) AS family_order, doc_id AS pos, text AS query, lang FROM documents)"
JUDGED = f"""{DOCS}, n AS (SELECT *, {NORMAL.format(t='query')} AS q FROM docs), e AS (SELECT *, CASE WHEN query IS NULL THEN 'malformed' WHEN {WORDS.format(t='q')} < 8 THEN 'short' WHEN regexp_matches(q, '(?i)([#$%&*]{{3}} [^ ]+[#$%&*]{{3}} [^ ]+[#$%&*]{{3}}|\\b(spam|lorem ipsum)\\b)') THEN 'artifact' END AS early FROM n),
o AS (SELECT *, row_number() OVER w AS r, first_value(family) OVER w AS ff FROM (SELECT *, {KEY.format(t='q')} AS k FROM e WHERE early IS NULL) WINDOW w AS (PARTITION BY k ORDER BY family_order, pos)),
judged AS (SELECT doc_id, family, family_order, pos, early AS reason FROM e WHERE early IS NOT NULL UNION ALL SELECT doc_id, family, family_order, pos, CASE WHEN r = 1 THEN 'kept' WHEN ff = family THEN 'within' ELSE 'cross' END FROM o)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return Y.judge(docs(spark, d), "query", "family", "family_order", "pos", ARTIFACTS)


@R.add(f"SELECT doc_id, md5({NORMAL.format(t='text')}) AS normal, md5({KEY.format(t='text')}) AS key FROM documents")
def txt_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(normal(F.col("text"))).alias("normal"), F.md5(key(F.col("text"))).alias("key"))


@R.add(f"WITH n AS (SELECT conv_id, role AS family, turn, {NORMAL.format(t='text')} AS q FROM conversations) SELECT conv_id, family, md5(q) AS digest FROM n WHERE {WORDS.format(t='q')} >= 3")
def json_parse_families(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three kinds, made of conversations: fenced with a `families` level, bare, and amid other words."""
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.collect_list("text").alias("items"))
    m = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "items"))).alias("m"))
    json = F.to_json("m")
    raw = F.when(F.size("m") == 1, json).when(F.size("m") == 2, F.concat(F.lit('```json\n{"families": '), json, F.lit("}\n```"))).otherwise(F.concat(F.lit("Here it is: "), json, F.lit(" - done.")))
    return Y.family_rows(m.select("conv_id", raw.alias("raw")), "raw", ["conv_id"]).select("conv_id", "family", F.md5("query").alias("digest"))


@R.add("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {k}, '{f}', {f != 'Q1_templates'})" for p, names in Y.PRESETS.items() for k, f in enumerate(names)) + ") t(preset, family_order, family, generated)")
def family_presets(spark: SparkSession, d: str) -> DataFrame:
    both = [Y.preset(spark, p).withColumn("preset", F.lit(p)) for p in Y.PRESETS]
    return both[0].unionByName(both[1]).select("preset", "family_order", "family", "generated")


SPLIT = "split AS (SELECT doc_id, source, n_chars, CASE WHEN row_number() OVER (ORDER BY md5('held:' || doc_id), doc_id) <= 40 THEN 'validation' ELSE 'train' END AS part FROM documents)"
FAILED = "split.part = 'validation' AND n_chars < 1000"


@R.add(f"WITH {SPLIT}, fam AS (SELECT doc_id, source AS family FROM split UNION ALL SELECT doc_id, 'Q3_validation_failures' FROM split WHERE {FAILED}) SELECT family, count(*) AS n, family <> 'Q3_validation_failures' AS main FROM fam GROUP BY family")
def validation_failures(spark: SparkSession, d: str) -> DataFrame:
    """Families with one of failures (here: short documents) of the validation split; main runs leave that one out."""
    s = split_exact(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id", 40, "held")
    failed = Y.failure_family(s, F.col("n_chars") < 1000, "part")
    every = s.withColumn("family", F.col("source")).unionByName(failed)
    main = Y.main_run(every, "family").select("family").distinct().withColumn("main", F.lit(True))
    n = every.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return n.join(main, "family", "left").select("family", "n", F.coalesce("main", F.lit(False)).alias("main"))


def runs_sql(name: str, source: str, id: str) -> str:
    """{name}_k (id, key) and {name} (id, h), the distinct runs of five words."""
    more = " || ' ' || ".join(f"lead(x, {i}) OVER w" for i in range(1, 5))
    return f"""{name}_k AS MATERIALIZED (SELECT {id} AS id, {KEY.format(t='text')} AS k FROM {source}),
{name}_w AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT id, list_filter(string_split(k, ' '), lambda x: x <> '') AS w FROM {name}_k)),
{name} AS MATERIALIZED (SELECT DISTINCT id, h FROM (SELECT id, x || ' ' || {more} AS h FROM {name}_w WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE h IS NOT NULL)"""


@R.add(f"""WITH {runs_sql('c', 'benchmark', 'item_id')}, {runs_sql('t', 'documents', 'doc_id')},
found AS (SELECT id, count(*) AS n, count(known.h) AS f FROM t LEFT JOIN (SELECT DISTINCT h FROM c) known ON known.h = t.h GROUP BY id)
SELECT t_k.id AS doc_id FROM t_k LEFT JOIN found ON found.id = t_k.id WHERE (n IS NULL OR f = 0 OR f * 1000 < n * 800) AND (k IS NULL OR k NOT IN (SELECT k FROM c_k WHERE k IS NOT NULL))""")
def leak_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents as proxies, benchmark items as captions."""
    return Y.leak_filter(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, d, "benchmark"), "text").select("doc_id")


@R.add(f"WITH {DOCS}, r AS (SELECT doc_id, family, row_number() OVER (PARTITION BY family, {KEY.format(t='query')} ORDER BY pos) AS r FROM docs) SELECT doc_id, family FROM r WHERE r = 1")
def dedupe_within(spark: SparkSession, d: str) -> DataFrame:
    return Y.first_of_key(docs(spark, d), ["family"], "query", ["pos"]).select("doc_id", "family")


@R.add(f"WITH {JUDGED} SELECT doc_id, family, reason FROM judged")
def postprocess_families(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("doc_id", "family", "reason")


@R.add(f"WITH {JUDGED} SELECT reason, count(*) AS n FROM judged GROUP BY reason")
def postprocess_report(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@R.add(f"""WITH {JUDGED}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY pos) AS place FROM judged WHERE reason = 'kept'),
g AS (SELECT *, row_number() OVER (ORDER BY family = 'src0', place DESC, family_order) AS gone, count(*) OVER () AS n FROM k) SELECT doc_id, family FROM g WHERE gone > n - 500""")
def trim_to_total(spark: SparkSession, d: str) -> DataFrame:
    """The kept texts, trimmed to 500 with family src0 protected."""
    kept = judged(spark, d).where("reason = 'kept'")
    return Y.trim(kept, "family", "family_order", "pos", ["doc_id"], 500, ["src0"]).select("doc_id", "family")


@R.add(f"WITH {DOCS}, r AS (SELECT doc_id, family, row_number() OVER (PARTITION BY family ORDER BY pos) AS r FROM docs) SELECT doc_id, family FROM r WHERE r <= 7")
def cap_families(spark: SparkSession, d: str) -> DataFrame:
    return Y.cap(docs(spark, d), "family", "pos", 7).select("doc_id", "family")


@R.add(f"WITH {PARTS} SELECT phrase, count(*) AS n FROM (SELECT {PHRASED}) WHERE phrase IS NOT NULL GROUP BY phrase")
def clean_phrase(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select(F.explode(F.split("text", r"[,;/|]+")).alias("p"))
    return parts.select(phrase(F.col("p")).alias("phrase")).where("phrase IS NOT NULL").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


TOP = f"{PARTS}, top AS (SELECT phrase, count(*) AS n FROM (SELECT {PHRASED}) WHERE phrase IS NOT NULL GROUP BY phrase ORDER BY n DESC, phrase LIMIT 30)"


@R.add(f"WITH {TOP} SELECT phrase, n FROM top")
def attr_topn(spark: SparkSession, d: str) -> DataFrame:
    """The thirty most frequent phrases of all documents."""
    return Y.top_phrases(table(spark, d, "documents"), "text", 30)


EXPANDED = f"""{TOP}, t(template, text) AS (VALUES (0, 'a person {{a}}'), (1, 'a photo of a person {{a}}'), (2, 'someone {{a}} in a public place'), (3, 'a surveillance image of a person {{a}}')),
q AS (SELECT phrase, CAST(template AS INT) AS template, replace(text, '{{a}}', phrase) AS query FROM top, t)"""


@R.add(f"WITH {EXPANDED} SELECT phrase, template, query, 'at ' || CASE WHEN lower(phrase[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END || ' ' || phrase AS place FROM q ORDER BY md5('template:' || query), query LIMIT 100")
def template_expand(spark: SparkSession, d: str) -> DataFrame:
    """Phrases in templates, of which one hundred are drawn."""
    q = Y.shuffled(Y.expand(attr_topn(spark, d), "phrase"), "query", 100, "template")
    return q.withColumn("place", F.concat(F.lit("at "), Y.article(F.col("phrase")), F.lit(" "), F.col("phrase")))


@R.add(f"WITH {EXPANDED} SELECT query, unnest([replace(query, 'a person', 'an individual'), replace(query, 'a photo of', 'an image showing')]) AS paraphrase FROM q")
def paraphrase_rules(spark: SparkSession, d: str) -> DataFrame:
    return Y.paraphrase(Y.expand(attr_topn(spark, d), "phrase").select("query"), "query")


@R.add(f"""WITH s AS (SELECT lang AS family, {KEY.format(t='text')} AS k, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT family, k, bool_or(quality = 1) AS x, bool_or(quality = 0) AS y FROM s GROUP BY family, k),
w AS (SELECT 'all' AS family, k, bool_or(x) AS x, bool_or(y) AS y FROM c GROUP BY k) SELECT family, count(*) FILTER (x) AS first, count(*) FILTER (y) AS second, count(*) FILTER (x AND y) AS overlap, round(count(*) FILTER (x AND y) / count(*), 4) AS jaccard FROM (SELECT * FROM c UNION ALL SELECT * FROM w) GROUP BY family""")
def compare_modes(spark: SparkSession, d: str) -> DataFrame:
    """Texts of either quality as the outputs of two modes, languages as families."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", "text", "quality")
    return Y.compare(j.where("quality = 1"), j.where("quality = 0"), "lang", "text")


@R.add(f"""WITH g AS (SELECT lang, {KEY.format(t='text')} AS k, count(*) AS c, sum({WORDS.format(t=NORMAL.format(t='text'))}) AS w FROM documents GROUP BY 1, 2)
SELECT lang, CAST(sum(c) AS BIGINT) AS raw, count(*) AS unique_texts, round(1 - count(*) / sum(c), 4) AS duplicate_rate, CAST(sum(w) AS BIGINT) AS words FROM g GROUP BY lang""")
def generation_stats(spark: SparkSession, d: str) -> DataFrame:
    return Y.generation_stats(table(spark, d, "documents"), "lang", "text")


@R.add(f"""WITH f AS (SELECT b, count(*) AS n FROM (SELECT {KEY.format(t='text')} AS k, min(conv_id) AS b FROM conversations GROUP BY 1) GROUP BY b), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(n, 0) AS fresh, CAST(sum(coalesce(n, 0)) OVER (ORDER BY conv_id) AS BIGINT) AS so_far FROM a LEFT JOIN f ON b = conv_id""")
def progress_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as batches: distinct texts so far."""
    return Y.progress(table(spark, d, "conversations"), "conv_id", "text")
