"""Families of proxy texts: parsing, cleaning with reasons, trimming, templates, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.text import key, normal, phrase, words

# The templates of an attribute, and the replacements of a paraphrase.
TEMPLATES = ("a person {a}", "a photo of a person {a}", "someone {a} in a public place", "a surveillance image of a person {a}")
PARAPHRASES = (("a person", "an individual"), ("a photo of", "an image showing"))

# The names of families, in order, of each preset.
PRESETS = {
    "default": ("anomaly", "normal", "hard_cases", "appearance"),
    "hybrid": ("Q1_templates", "Q2_deepseek_paraphrases", "Q3_deepseek_anomaly", "Q4_deepseek_hard_cases", "Q5_deepseek_normal", "Q6_deepseek_appearance"),
}


def preset(spark: SparkSession, name: str) -> DataFrame:
    """(family_order, family, generated) of a preset; texts of Q1_templates come from templates, all others are generated."""
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {', '.join(PRESETS)}")
    return spark.createDataFrame([(k, f, f != "Q1_templates") for k, f in enumerate(PRESETS[name])], "family_order int, family string, generated boolean")


def failure_family(df: DataFrame, failed: Column, part: str, name: str = "Q3_validation_failures") -> DataFrame:
    """Rows of the validation split that failed, tagged as a family of their own; rows of other splits never get in, nor do
    rows whose part or failure is null."""
    return df.where((F.col(part) == "validation") & failed).withColumn("family", F.lit(name))


def main_run(df: DataFrame, family: str, ablation: tuple[str, ...] = ("Q3_validation_failures",)) -> DataFrame:
    """Rows of families that are not for ablations only; rows without a family stay."""
    return df.where(~F.coalesce(F.col(family).isin(*ablation), F.lit(False)))


def leak_filter(df: DataFrame, id: str, text: str, captions: DataFrame, caption: str, size: int = 5, share: float = 0.8) -> DataFrame:
    """Rows whose text neither equals a caption by its key nor derives from captions: less than the share of its distinct
    runs of size words occur in them. A text of fewer words has no runs, and a null one has no key: only equality, or
    nothing, can make them go. ids must differ.

    Runs meet as hashes with the distinct runs of all captions, and are counted per text: no pairs of texts.
    """

    def runs(t: Column) -> Column:
        w = F.filter(F.split(key(t), " "), lambda x: x != "")
        n = F.greatest(F.size(w) - (size - 1), F.lit(0))
        # Shifted copies side by side: a lambda over positions would work out the words once per position.
        shifted = F.arrays_zip(*(F.slice(w, F.lit(i + 1), n).alias(f"w{i}") for i in range(size)))
        return F.array_distinct(F.transform(shifted, lambda x: F.xxhash64(x)))

    known = captions.select(F.explode(runs(F.col(caption))).alias("_h")).distinct()
    own = df.select(F.col(id).alias("_id"), F.explode(runs(F.col(text))).alias("_h"))
    found = own.join(known, "_h", "left_semi").groupBy("_id").agg(F.count(F.lit(1)).alias("_found"))
    equal = captions.select(F.xxhash64(key(F.col(caption))).alias("_k"), key(F.col(caption)).alias("_key")).where("_key IS NOT NULL").distinct()
    rest = df.withColumn("_key", key(F.col(text))).withColumn("_k", F.xxhash64("_key")).join(equal, ["_k", "_key"], "left_anti").drop("_k", "_key")
    # Whole numbers: 4 of 5 is not less than 0.8.
    derived = F.coalesce(F.col("_found"), F.lit(0)) * 1000 >= F.size(runs(F.col(text))) * F.lit(round(share * 1000))
    return rest.join(found, F.col(id) == F.col("_id"), "left").where(F.col("_found").isNull() | ~derived).select(*df.columns)


def parse_response(raw: Column) -> Column:
    """map<family, array<text>> of a model's answer: plain or fenced JSON, or the widest {...} in it, with or without a
    `families` level. Null if there is no such object."""
    shape = "map<string,array<string>>"
    bare = F.trim(F.regexp_replace(raw, r"(?m)^```(?:json)?\s*|\s*```$", ""))
    inside = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    json = F.when(F.get_json_object(bare, "$").isNotNull(), bare).otherwise(F.nullif(inside, F.lit("")))
    return F.from_json(F.coalesce(F.get_json_object(json, "$.families"), json), shape)


def family_rows(df: DataFrame, raw: str, keys: list[str], least_words: int = 3) -> DataFrame:
    """(keys, family, pos, query) of parsed answers; texts of fewer words are left out."""
    m = df.select(*keys, F.explode(parse_response(F.col(raw))).alias("family", "items"))
    rows = m.select(*keys, "family", F.posexplode("items").alias("pos", "query")).withColumn("query", normal(F.col("query")))
    return rows.where(words(F.col("query")) >= least_words)


def first_of_key(df: DataFrame, group: list[str], text: str, order: list[str]) -> DataFrame:
    """Rows whose text is the first of its key in a group."""
    w = Window.partitionBy(*group, "_key").orderBy(*order)
    return df.withColumn("_key", key(F.col(text))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_key")


def judge(df: DataFrame, text: str, family: str, family_order: str, pos: str, artifacts: str, least_words: int = 8, across: bool = True) -> DataFrame:
    """Adds reason: malformed (null), short, artifact, within (an earlier text of the family has its key), cross (a
    family before it has), or kept. Families come by family_order, texts by pos; only texts that pass the first
    rules make others duplicates, so a key's first such text is kept and its family tells the two kinds apart."""
    q = F.col("_q")  # a column of its own: what follows looks at it several times
    df = df.withColumn("_q", normal(F.col(text)))
    early = F.when(F.col(text).isNull(), "malformed").when(words(q) < least_words, "short").when(q.rlike(artifacts), "artifact")
    rows = df.withColumn("reason", early)
    # Only rows that pass meet in windows, by a hash of their key; the key itself orders keys of equal hashes.
    passed = rows.where("reason IS NULL").withColumn("_key", key(q))
    first = Window.partitionBy(F.xxhash64("_key"), "_key", *([] if across else [family])).orderBy(family_order, pos)
    ranked = passed.withColumn("_n", F.row_number().over(first)).withColumn("_f", F.first(family).over(first))
    # Within a later family, its own first text meets the earlier family's, and so do the others: all are cross.
    judged = ranked.withColumn("reason", F.when(F.col("_n") == 1, "kept").when(F.col("_f") == F.col(family), "within").otherwise("cross"))
    return judged.drop("_q", "_key", "_n", "_f").unionByName(rows.where("reason IS NOT NULL").drop("_q"))


def trim(df: DataFrame, family: str, family_order: str, pos: str, key_columns: list[str], total: int, protected: list | None = None) -> DataFrame:
    """As many rows as total: rows go from the end of the largest family that isn't protected, protected ones last.

    Taking the last text of the largest family again and again takes texts in falling order of their place in the
    family; so the rows to go are the first ones of one order, without any loop.
    """
    n = df.count()
    if n <= total:
        return df
    w = Window.partitionBy(family).orderBy(pos)
    placed = df.withColumn("_place", F.row_number().over(w)).withColumn("_kept", F.col(family).isin(protected or []))
    gone = placed.orderBy("_kept", F.desc("_place"), family_order).limit(n - total).select(*key_columns)
    return df.join(gone, key_columns, "left_anti")


def cap(df: DataFrame, family: str, pos: str, most: int) -> DataFrame:
    """The first rows of each family."""
    w = Window.partitionBy(family).orderBy(pos)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def top_phrases(df: DataFrame, text: str, n: int) -> DataFrame:
    """(phrase, n): the most frequent phrases between commas, semicolons, slashes and bars; ties by phrase."""
    raw = df.select(F.explode(F.split(text, r"[,;/|]+")).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    parts = raw.select(phrase(F.col("p")).alias("phrase"), "n").where("phrase IS NOT NULL")  # each distinct part is cleaned once
    return parts.groupBy("phrase").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "phrase").limit(n)


def expand(attributes: DataFrame, attribute: str, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """(attribute, template, query): every attribute in every template; templates are a short list."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("template"), F.lit(t).alias("text")) for k, t in enumerate(templates)))).alias("t")
    return attributes.select(attribute, each).select(attribute, "t.template", F.replace("t.text", F.lit("{a}"), F.col(attribute)).alias("query"))


def paraphrase(df: DataFrame, text: str, rules: tuple[tuple[str, str], ...] = PARAPHRASES) -> DataFrame:
    """One row per rule and text, with the rule's words replaced."""
    return df.withColumn("paraphrase", F.explode(F.array(*(F.replace(text, F.lit(a), F.lit(b)) for a, b in rules))))


def article(noun: Column) -> Column:
    return F.when(F.lower(F.substring(noun, 1, 1)).isin("a", "e", "i", "o", "u"), F.lit("an")).otherwise(F.lit("a"))


def shuffled(df: DataFrame, text: str, n: int, seed: str) -> DataFrame:
    """n rows in the order of a hash of their text."""
    return df.orderBy(F.md5(rng.keyed(seed, text)), text).limit(n)


def compare(a: DataFrame, b: DataFrame, family: str, text: str) -> DataFrame:
    """(family, first, second, overlap, jaccard) of the distinct keys of two sides, and of all families together."""
    side = lambda df, name: df.select(F.col(family).alias("family"), key(F.col(text)).alias("k")).distinct().withColumn(name, F.lit(True))
    both = side(a, "x").join(side(b, "y"), ["family", "k"], "full_outer").select("family", "k", F.coalesce("x", F.lit(False)).alias("x"), F.coalesce("y", F.lit(False)).alias("y"))
    whole = both.groupBy("k").agg(F.max("x").alias("x"), F.max("y").alias("y")).select(F.lit("all").alias("family"), "k", "x", "y")
    r = both.unionByName(whole).groupBy("family").agg(F.count_if("x").alias("first"), F.count_if("y").alias("second"), F.count_if(F.col("x") & F.col("y")).alias("overlap"), F.count(F.lit(1)).alias("_u"))
    return r.select("family", "first", "second", "overlap", F.round(F.col("overlap") / F.col("_u"), 4).alias("jaccard"))


def generation_stats(df: DataFrame, family: str, text: str) -> DataFrame:
    """(family, raw, unique_texts, duplicate_rate, words)."""
    n = words(normal(F.col(text)))
    g = df.groupBy(family, key(F.col(text)).alias("_k")).agg(F.count(F.lit(1)).alias("c"), F.sum(n).alias("w"))
    s = g.groupBy(family).agg(F.sum("c").alias("raw"), F.count(F.lit(1)).alias("unique_texts"), F.sum("w").alias("words"))
    return s.select(family, "raw", "unique_texts", F.round(1 - F.col("unique_texts") / F.col("raw"), 4).alias("duplicate_rate"), "words")


def progress(df: DataFrame, batch: str, text: str) -> DataFrame:
    """(batch, fresh, so_far): texts first seen in a batch, and all seen up to it, in the order of batches.

    The running sum is made of partition totals and sums inside range partitions, not of one global window.
    """
    first = df.groupBy(key(F.col(text)).alias("_k")).agg(F.min(batch).alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("n"))
    batches = df.select(F.col(batch).alias("b")).distinct().join(first.withColumnRenamed("_b", "b"), "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("fresh"))
    ranged = batches.repartitionByRange("b").withColumn("_p", F.spark_partition_id()).persist()
    total = ranged.groupBy("_p").agg(F.sum("fresh").alias("t"))  # one row per partition
    before = total.select("_p", (F.sum("t").over(Window.orderBy("_p")) - F.col("t")).alias("before"))
    inner = F.sum("fresh").over(Window.partitionBy("_p").orderBy("b"))
    return ranged.join(F.broadcast(before), "_p").select(F.col("b").alias(batch), "fresh", (F.col("before") + inner).alias("so_far"))
