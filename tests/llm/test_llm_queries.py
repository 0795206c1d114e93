"""Registered corpus queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import pytest
from conftest import DATA
from test_oracles import rows_of

import corpus_pipeline
from tamis.llm import queries as corpus

ORACLES = corpus.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, oracle, name):
    df = corpus.queries()[name](spark, DATA)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = oracle.execute(ORACLES[name])
    assert ours == rows_of([c[0] for c in result.description], result.fetchall())


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in corpus.queries())
    assert numbers == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids and ids <= before, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.count() == len(ids)
        docs, before = out, ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_on_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "w " * 3000, None, None, 6000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            docs.count()
    assert docs.columns[0] == "doc_id"


def test_stages_by_brute_force(spark):
    """Each stage against a plain version of it, on what the stage before it really kept."""
    from test_llm_operators import ALNUM, LOW, brute_groups, brute_lines, check_pieces

    from tamis.llm.toxicity import CUT, toxicity

    def rows(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, DATA)
    scores = {r.doc_id: r.score for r in toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert {i for i, _ in rows(clean)} == {i for i, s in scores.items() if s < CUT}

    lined = stages["line_dedup"](spark, clean, DATA)
    got = sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows(lined))
    assert got == sorted((i, s) for i, _, _, s in brute_lines(rows(clean)))
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = stages["near_dedup"](spark, lined, DATA)
    assert {i for i, _ in rows(single)} == {i for i, (_, c) in brute_groups(rows(lined), 80).items() if i == c}

    fresh = stages["decontamination"](spark, single, DATA)
    passages = [ALNUM.findall(r.text.translate(LOW)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(p[k : k + min(10, len(p))]) for p in passages for k in range(len(p) - min(10, len(p)) + 1) if p}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = ALNUM.findall(t.translate(LOW))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert {i for i, _ in rows(fresh)} == {i for i, t in rows(single) if not hit(t)}

    check_pieces(rows(fresh), stages["packing"](spark, fresh, DATA).collect(), 2048)
