"""Experiment records (events stand in for runs), sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as E
from ..operators.stats import wilson
from ..operators.sampling import exact_sample
from ..sources.files import WRAPPERS, read_json_mixed, read_jsonl, read_wrapped, resolve_paths, scratch, texts_of, write_json_arrays
from ..sources.pairs import PAIRS_SQL, pairs, table
from .base import UNIFORM, Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

RUNS_SQL = """recs AS (SELECT event_type AS method, CAST((CAST(props->>'k' AS INT) // 20) * 10 + 10 AS INT) AS budget, CAST(user_id % 3 AS INT) AS seed, CASE WHEN CAST(props->>'k' AS INT) % 5 = 0 THEN 'anomaly' ELSE 'normal' END AS category, user_id, least(value, 100) AS v FROM events)"""
METHODS = ("click", "error", "purchase", "signup", "view")


def records(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_type").alias("method"), ((F.floor(k / 20)) * 10 + 10).cast("int").alias("budget"), F.pmod("user_id", F.lit(3)).cast("int").alias("seed"),
        F.when(k % 5 == 0, "anomaly").otherwise("normal").alias("category"), "user_id", F.least("value", F.lit(100.0)).alias("v"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("method", "budget", "seed", "category").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n_queries"))


RUN_SQL = f"{RUNS_SQL}, runs AS (SELECT method, budget, seed, category, avg(v) AS v, count(*) AS n_queries FROM recs GROUP BY ALL)"


@R.add(f"WITH {RUN_SQL} SELECT method, budget, seed, category, round(v, 4) AS mean_r1, n_queries FROM runs")
def runs_long(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).select("method", "budget", "seed", "category", F.round("v", 4).alias("mean_r1"), "n_queries")


@R.add(f"WITH {RUN_SQL} SELECT method, budget, category, round(avg(v), 3) AS mean, round(coalesce(stddev_samp(v), 0), 3) AS std, count(v) AS n FROM runs GROUP BY method, budget, category")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.across_seeds(runs(spark, d), ["method", "budget", "category"], "v")


@R.add(f"WITH {RUN_SQL} SELECT method, " + ", ".join(f"round(avg(v) FILTER (budget = {b}), 3) AS b{b}" for b in (10, 20, 30, 40, 50)) + " FROM runs GROUP BY method")
def results_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = runs(spark, d).groupBy("method").pivot("budget", [10, 20, 30, 40, 50]).agg(F.avg("v"))
    return p.select("method", *(F.round(F.col(str(b)), 3).alias(f"b{b}") for b in (10, 20, 30, 40, 50)))


@R.add(f"WITH {RUN_SQL}, e AS (SELECT 'overall' AS category, method, budget, v FROM runs UNION ALL SELECT category, method, budget, v FROM runs WHERE category = 'anomaly') SELECT category, method, " + ", ".join(f"round(avg(v) FILTER (budget = {b}), 3) AS b{b}" for b in (10, 20, 30, 40, 50)) + " FROM e GROUP BY category, method")
def sweep_table(spark: SparkSession, d: str) -> DataFrame:
    """Means over seeds by method and budget, of all runs and of one category."""
    r = runs(spark, d)
    each = r.withColumn("category", F.lit("overall")).unionByName(r.where("category = 'anomaly'"))
    p = each.groupBy("category", "method").pivot("budget", [10, 20, 30, 40, 50]).agg(F.avg("v"))
    return p.select("category", "method", *(F.round(F.col(str(b)), 3).alias(f"b{b}") for b in (10, 20, 30, 40, 50)))


@R.add(f"WITH {RUN_SQL}, f AS (SELECT 'metrics__' || method || '_x_b' || budget || '_seed' || seed || '_eval' AS stem FROM runs GROUP BY ALL), t AS (SELECT stem, list_filter(regexp_split_to_array(stem, '__|_'), lambda x: x <> '' AND NOT list_contains(['metrics', 'stage', 'c', 'stagec', 'eval', 'norm'], lower(x))) AS t FROM f)"
       "SELECT stem, array_to_string(list_filter(t, lambda x: NOT regexp_matches(x, '(?i)^(s|seed)[0-9]+$') AND NOT regexp_matches(x, '(?i)^(b|budget)?[0-9.]+$')), '_') AS method, regexp_extract(list_filter(t, lambda x: regexp_matches(x, '(?i)^(b|budget)?[0-9.]+$'))[-1], '[0-9.]+') AS budget, CAST(regexp_extract(list_filter(t, lambda x: regexp_matches(x, '(?i)^(s|seed)[0-9]+$'))[-1], '[0-9]+') AS INT) AS seed FROM t")  # fmt: skip
def parse_run_name(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select("method", "budget", "seed").distinct()
    stem = F.format_string("metrics__%s_x_b%d_seed%d_eval", "method", "budget", "seed")
    return r.select(stem.alias("stem")).select("stem", *E.run_name(F.col("stem")))


@R.add("SELECT DISTINCT url, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS label FROM pages")
def method_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("url", E.label(F.col("url")).alias("label")).distinct()


@R.add("SELECT a AS alpha, s AS share, 'a' || lpad(CAST(CAST(round(a * 100) AS INT) AS VARCHAR), 3, '0') || '_lv' || lpad(CAST(CAST(round(s * 100) AS INT) AS VARCHAR), 3, '0') AS tag FROM (VALUES (0.6::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) x(a), (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) y(s)")
def grid_tags(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([(x,) for x in (0.6, 0.75, 0.9)], "alpha double")
    s = spark.createDataFrame([(x,) for x in (0.5, 0.7, 0.9)], "share double")
    return a.crossJoin(s).withColumn("tag", E.percent_tag(F.col("alpha"), F.col("share")))


@R.add(f"""WITH {RUNS_SQL}, grid AS (SELECT method, user_id, budget FROM (SELECT DISTINCT method FROM recs), (SELECT DISTINCT user_id FROM recs), (SELECT DISTINCT budget FROM recs))
SELECT method, user_id, budget FROM grid EXCEPT SELECT method, user_id, budget FROM recs""")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of methods, users and budgets in which nothing was recorded."""
    r = records(spark, d)
    grid = r.select("user_id").distinct().crossJoin(F.broadcast(r.select("method").distinct())).crossJoin(F.broadcast(r.select("budget").distinct()))
    return E.missing(grid, r, ["method", "user_id", "budget"]).select("method", "user_id", "budget")


@R.add(f"""WITH {RUNS_SQL}, planned AS (SELECT DISTINCT method, user_id, budget FROM recs), done AS (SELECT method, user_id, budget FROM recs GROUP BY ALL HAVING count(DISTINCT category) = 2)
SELECT * FROM planned EXCEPT SELECT * FROM done""")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d)
    keys = ["method", "user_id", "budget"]
    return E.unfinished(r.select(*keys).distinct(), r, keys, "category", 2)


@R.add(f"WITH {RUNS_SQL}, want(method) AS (VALUES ('click'), ('view'), ('signup'), ('refund')) SELECT want.method, count(recs.method) AS n, count(recs.method) > 0 AS present FROM want LEFT JOIN recs USING (method) GROUP BY want.method")
def verify_methods(spark: SparkSession, d: str) -> DataFrame:
    want = spark.createDataFrame([(m,) for m in ("click", "view", "signup", "refund")], "method string")
    n = records(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    out = want.join(n, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("present", F.col("n") > 0)


@R.add(f"""WITH {RUNS_SQL}, g AS (SELECT method, category, count(*) AS n, 100.0 * avg(CASE WHEN v > 20 THEN 1.0 ELSE 0.0 END) AS share FROM recs GROUP BY method, category)
SELECT method, category, n, round(share, 4) AS share, round(100 * ((share / 100 + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(share / 100 * (1 - share / 100) / n + 1.96 * 1.96 / (4.0 * n * n))), 2) AS low,
  round(100 * ((share / 100 + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(share / 100 * (1 - share / 100) / n + 1.96 * 1.96 / (4.0 * n * n))), 2) AS high FROM g""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    g = records(spark, d).groupBy("method", "category").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((F.col("v") > 20).cast("double"))).alias("share"))
    low, high = wilson(F.col("share"), F.col("n"))
    return g.select("method", "category", "n", F.round("share", 4).alias("share"), low.alias("low"), high.alias("high"))


PERM_SQL = f"""{RUNS_SQL}, m AS (SELECT method, user_id, avg(v) AS v FROM recs GROUP BY ALL), diffs AS (SELECT a.method, a.user_id, a.v - b.v AS x FROM m a JOIN m b ON b.user_id = a.user_id AND b.method = 'view' WHERE a.method <> 'view'),
fl AS (SELECT method, b, round(abs(avg(x * CASE WHEN {UNIFORM.format(key="'perm:' || b || ':' || user_id")} < 0.5 THEN 1.0 ELSE -1.0 END)), 9) AS s FROM diffs, range(500) t(b) GROUP BY method, b),
obs AS (SELECT method, round(abs(avg(x)), 9) AS o FROM diffs GROUP BY method), ps AS (SELECT method, (count(*) FILTER (s >= o) + 1) / 501.0 AS p FROM fl JOIN obs USING (method) GROUP BY method)"""


def flip_test(spark: SparkSession, d: str) -> DataFrame:
    m = records(spark, d).groupBy("method", "user_id").agg(F.avg("v").alias("v"))
    base = m.where("method = 'view'").select("user_id", F.col("v").alias("w"))
    diffs = m.where("method <> 'view'").join(base, "user_id").select("method", "user_id", (F.col("v") - F.col("w")).alias("x"))
    return E.sign_flip_test(diffs, "method", "user_id", "x", 500, "perm")


@R.add(f"WITH {PERM_SQL} SELECT method, round(p, 6) AS p FROM ps")
def perm_test(spark: SparkSession, d: str) -> DataFrame:
    """Paired by user, each method against 'view'."""
    return flip_test(spark, d).withColumn("p", F.round("p", 6))


@R.add(f"WITH {PERM_SQL}, s AS (SELECT method, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, method) + 1)) AS s FROM ps) SELECT method, round(p, 6) AS p, round(max(s) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s")
def holm(spark: SparkSession, d: str) -> DataFrame:
    h = E.holm(flip_test(spark, d), "p", "method")
    return h.select("method", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@R.add(f"WITH {RUN_SQL}, m AS (SELECT method, budget, round(avg(v), 9) AS s FROM runs GROUP BY method, budget), r AS (SELECT method, rank() OVER (PARTITION BY budget ORDER BY s DESC) AS r FROM m) SELECT method, round(avg(r), 4) AS avg_rank FROM r GROUP BY method")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    m = runs(spark, d).groupBy("method", "budget").agg(F.round(F.avg("v"), 9).alias("s"))
    return E.average_place(m, "budget", "method", "s").withColumn("avg_rank", F.round("avg_rank", 4))


@R.add(f"WITH {PAIRS_SQL} SELECT family, count(*) AS n, min(len(z_t)) AS least_dim, max(len(z_t)) AS most_dim FROM pairs GROUP BY family")
def family_counts_dims(spark: SparkSession, d: str) -> DataFrame:
    size = F.size("z_t").cast("long")
    return pairs(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least_dim"), F.max(size).alias("most_dim"))


@R.add("""SELECT 'both' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)""")
def set_ops_methods(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "customers only")).unionByName(count(a.union(b).distinct(), "either"))


# ---- sources ---------------------------------------------------------------------------------------------


@R.add("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def src_jsonl_permissive(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON lines, among blank and broken ones."""
    path = scratch(spark, "lines")
    c = table(spark, d, "conversations").select(F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    broken = c.select(F.explode(F.array(F.col("value"), F.lit(""), F.concat(F.lit("{"), F.substring("value", 3, 9)))).alias("value"))
    broken.write.text(path)
    return read_jsonl(spark, path, "conv_id long, turn long, text string").select("conv_id", "turn", F.md5("text").alias("digest"))


@R.add("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def src_json_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Some conversations as one array, the others as an object per line."""
    path = scratch(spark, "mixed")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("conv_id", "turn", "text")).alias("rows"))
    value = F.when(F.size("rows") > 2, F.array(F.to_json("rows"))).otherwise(F.transform("rows", lambda r: F.to_json(r)))
    c.select(F.explode(value).alias("value")).write.text(path)
    return read_json_mixed(spark, path, "struct<conv_id:long,turn:long,text:string>").select("conv_id", "turn", F.md5("text").alias("digest"))


@R.add("SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def src_json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as files of one indented array each, next to one of lines, and read back."""
    path = scratch(spark, "arrays")
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    write_json_arrays(c.where("conv_id % 3 > 0").repartition(3), f"{path}/arrays")
    c.where("conv_id % 3 = 0").select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/lines")
    return read_json_mixed(spark, f"{path}/*/part-*", "struct<conv_id:long,turn:long,text:string>").select("conv_id", "turn", F.md5("text").alias("digest"))


@R.add("SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('annotations:' || doc_id), doc_id LIMIT 150")
def src_json_wrapped_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of exact size of annotations that an object's data field holds."""
    path = scratch(spark, "wrapped")
    write_json_arrays(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), path, "data")
    return exact_sample(read_wrapped(spark, path, "struct<doc_id:long,lang:string,n_chars:long>"), "doc_id", 150, "annotations")


@R.add("""WITH t AS (SELECT conv_id, turn, trim(text, concat(' ', chr(10), chr(9), chr(13))) AS x FROM conversations), f AS (SELECT conv_id, x, min(turn) AS turn FROM t WHERE x <> '' GROUP BY conv_id, x)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS nth, md5(x) AS digest FROM f""")
def txt_extract_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Texts of JSON arrays, some of them wrapped in an object, whose items are strings or objects of three kinds."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    quoted = lambda name: F.to_json(F.struct(F.col("text").alias(name)))
    plain = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    item = F.when(F.col("role") == "system", quoted("caption")).when(F.col("role") == "user", quoted("query")).otherwise(plain)
    rows = c.select("conv_id", F.struct("turn", item.alias("item")).alias("i")).groupBy("conv_id").agg(F.sort_array(F.collect_list("i")).alias("i"))
    json = rows.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]")).alias("json"))
    wrapped = F.concat(F.lit('{"n": 1, "'), F.element_at(F.array(*(F.lit(w) for w in WRAPPERS)), (F.col("conv_id") % 4 + 1).cast("int")), F.lit('": '), F.col("json"), F.lit("}"))
    json = json.withColumn("json", F.when(F.col("conv_id") % 2 == 0, wrapped).otherwise(F.col("json")))
    out = texts_of(json, "json", ["conv_id"])
    w = Window.partitionBy("conv_id").orderBy("pos")
    return out.select("conv_id", (F.row_number().over(w) - 1).alias("nth"), F.md5("text").alias("digest"))


@R.add("""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS shard, coalesce(list_extract(string_split(url, '/'), -2), 'unknown') AS category FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
disk AS (SELECT shard FROM p GROUP BY shard HAVING count(*) >= 5) SELECT page_id, shard, category FROM p WHERE shard IN (SELECT shard FROM disk)""")
def pool_build(spark: SparkSession, d: str) -> DataFrame:
    """Annotated pages whose shard (host) is on disk (here: has five pages or more), with all fields, and their category."""
    p = table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("shard"), category(F.col("url")).alias("category"))
    disk = p.groupBy("shard").count().where("count >= 5").select("shard")
    return p.join(disk, "shard", "left_semi").select("page_id", "shard", "category")


def category(path):
    """The part before the last of a path."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("unknown"))


@R.add("SELECT page_id, coalesce(list_extract(string_split(url, '/'), -2), 'unknown') AS category FROM pages")
def category_from_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", category(F.col("url")).alias("category"))


@R.add("""WITH l AS (SELECT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '([.]html|/)$', '') AS stem, regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '([.]html|/)$') AS ext, url FROM pages),
r AS (SELECT stem, url, CASE ext WHEN '.html' THEN 0 WHEN '/' THEN 1 ELSE 2 END AS r FROM l) SELECT stem, min_by(url, {'r': r, 'u': url}) AS path FROM r GROUP BY stem""")
def path_resolve_priority(spark: SparkSession, d: str) -> DataFrame:
    """Of the addresses of one stem, the one with the first of three endings."""
    whole = F.regexp_extract("url", "://([^?#]*)", 1)
    listing = table(spark, d, "pages").select(F.regexp_replace(whole, "([.]html|/)$", "").alias("stem"), F.regexp_extract(whole, "([.]html|/)$", 1).alias("ext"), F.col("url").alias("path"))
    return resolve_paths(listing, listing, "stem", [".html", "/", ""])


@R.add("""WITH c AS (SELECT conv_id, min_by(role, turn) AS context FROM conversations GROUP BY conv_id) SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM c WHERE md5(context) = md5('user'))""")
def checkpoint_context_filter(spark: SparkSession, d: str) -> DataFrame:
    """Batches (conversations) are taken up again only if the digest of their context (first role) is the wanted one."""
    c = table(spark, d, "conversations")
    context = c.groupBy("conv_id").agg(F.md5(F.min_by("role", "turn")).alias("context")).where(F.col("context") == F.md5(F.lit("user")))
    return c.join(context.select("conv_id"), "conv_id", "left_semi").select("conv_id", "turn", "role")


# ---- streams ---------------------------------------------------------------------------------------------


@R.add("SELECT event_type AS method, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def stream_append_once(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a stream of files and appended once each; the sink, read back, has them all."""
    from ..streaming.records import append_once, read_records

    sink = scratch(spark, "sink")
    schema = table(spark, d, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    append_once(read_records(spark, f"{d}/events.parque[t]", schema), sink, scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(sink).groupBy(F.col("event_type").alias("method")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@R.add("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS method, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_windowed_means(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of the stream by event time, with a watermark; the stream's last state of every window."""
    from ..streaming.records import read_records, windowed_means

    sink = scratch(spark, "windows")
    schema = table(spark, d, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    events = read_records(spark, f"{d}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = windowed_means(events, "ts", "event_type", "value", "1 day", "2 days")
    flat = stream.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("method"), "n", F.round("mean", 6).alias("mean"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    flat.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(sink).groupBy("day", "method").agg(F.max_by(F.struct("n", "mean"), "batch").alias("s"))
    return last.select("day", "method", "s.n", "s.mean")
