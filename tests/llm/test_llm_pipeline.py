"""The pipeline against the stages done plainly, and the queries with SQL against DuckDB."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from test_llm_near import brute_components, shingle_set
from test_llm_rows import brute_contamination, brute_spans, check_packed

import corpus_pipeline
from ledgerflow.llm import oracles, queries, secrets, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder_of_tables(spark, make_docs, tmp_path_factory):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    item = fresh(20)
    texts = [fresh(rng.randint(20, 80)) for _ in range(120)]
    labels = []
    for i in range(60):
        labels.append((i, 1, int(i % 4 == 0)))
        if i % 4 == 0:
            texts[i] += " vile rotten nasty"
    texts[70] += " vile rotten"
    texts[80] = texts[81] = texts[82]
    texts[83] = texts[82] + " x"
    texts[90] += " " + item
    texts[91] += " password = abcdefgh12"
    texts += [None, ""]
    folder = str(tmp_path_factory.mktemp("tables"))
    make_docs(*enumerate(texts)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, item


def test_pipeline_equals_plain_stages(spark, folder_of_tables):
    folder, texts, item = folder_of_tables
    found = corpus_pipeline.run(spark, folder)
    left = {i: t for i, t in enumerate(texts) if not re.search("vile|rotten|nasty", t or "")}
    label = brute_components({i: shingle_set(t, 4) for i, t in left.items()}, 85)
    left = {i: t for i, t in left.items() if label[i] == i}
    assert {81, 82, 83} & set(left) == set()

    def clean(text):
        n, n_hit, _ = brute_contamination(text, [(1, item)])
        return not n_hit or 20 * n_hit < n

    left = {i: t for i, t in left.items() if clean(t)}
    assert 90 not in left
    for i, text in left.items():
        for start, end in reversed(secrets.merged([(s, e) for _, s, e in brute_spans(text or "", secrets.RULES)])):
            left[i] = f"{left[i][:start]}[secret]{left[i][end:]}"
    assert "[secret]" in left[91]
    check_packed(found.collect(), left)


def test_stages_return_documents(spark, folder_of_tables):
    folder, _, _ = folder_of_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_toxic_stage_keeps_clean_documents(spark, folder_of_tables):
    folder, texts, _ = folder_of_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert kept == {i for i, t in enumerate(texts) if not re.search("vile|rotten|nasty", t or "")}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        database.execute(f"create view {table} as select * from read_parquet('{SMALL}/{table}.parquet')")
    wanted = database.execute(oracles.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns)
    ours = sorted(tuple(str(row[c]) for c in columns) for row in found.collect())
    assert ours == sorted(tuple(str(v) for v in row) for row in wanted.fetchall())


def test_every_query_runs_on_the_small_tables(spark):
    for name in ("op2_paragraph_dedup", "op8_toxicity", "op10_neighbours"):
        assert queries.QUERIES[name](spark, SMALL).count() >= 0
