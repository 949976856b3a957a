"""The corpus pipeline against its operators and brute force, and on odd rows."""

from collections import Counter

import corpus_pipeline as pipeline
from conftest import SMOKE_DIR
from llm_rows import no_docs, odd_docs, words  # noqa: F401
from rostercast.llm import pu_quality, random_secrets
from rostercast.llm.common import table
from test_llm_links import brute_groups
from test_llm_rows import plain_spans


def test_stages_follow_each_other(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    d = "/root/testdata/sf0.01"
    good = pipeline.quality(spark, docs, d)
    assert good.schema == docs.schema
    bad = {r.doc_id for r in table(spark, d, "labels").collect() if r.quality == 0}
    kept = {r.doc_id for r in good.collect()}
    assert len(kept & bad) <= 0.02 * len(bad) and len(kept) >= 0.8 * docs.count()
    single = pipeline.one_of_each(spark, good, d)
    assert single.columns == docs.columns
    groups = brute_groups([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert {r.doc_id for r in single.collect()} == {i for i, _, root in groups if i == root}
    clean = pipeline.masked(spark, single, d)
    assert clean.schema == docs.schema and clean.count() == single.count()
    assert not any(plain_spans(r.text) for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    placed = pipeline.packed(spark, clean, d)
    assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in clean.collect()}


def test_run_applies_all_stages(spark):
    rows = pipeline.run(spark, SMOKE_DIR).collect()
    assert rows and [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]


def test_odd_rows_go_through(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs
    for _, stage in pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    ids = Counter(r.doc_id for r in docs.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[12] == 1 and ids[None] == 2 and ids[4] == ids[5] == ids[6] == 1
    for _, stage in pipeline.STAGES:
        assert stage(spark, no_docs, str(tmp_path)).count() == 0
    assert random_secrets.MASK in next(r.text for r in docs.collect() if r.doc_id == 17)
    assert pu_quality.THRESHOLD == 0.7


def test_texts_of_one_id_are_documents_of_their_own(spark, tmp_path):
    a, b, c = words(31, 60), words(32, 60), words(33, 60)
    rows = [(5, a), (5, b), (5, b), (5, b + " x"), (6, a), (7, b + " x"), (8, c), (3, c), *[(9, words(100 + i, 30)) for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = pipeline.one_of_each(spark, docs, str(tmp_path))
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got[5, a] == 1 and got[3, c] == 1 and got[5, b] + got[5, b + " x"] == 1  # one of each group, ids least
    assert got == Counter({k: 1 for k in got}) and len(got) == 43
    placed = pipeline.packed(spark, pipeline.masked(spark, out, str(tmp_path)), str(tmp_path))
    assert placed.where("piece = 0 and doc_id = 9").count() == 40
