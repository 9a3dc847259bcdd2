"""The pipeline stage by stage against plain Python, and the entry."""

import corpus_pipeline
from tests.llm.test_dedup import near_brute
from tests.llm.test_text_queries import contamination_brute

DIR = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, DIR).cache()
        kept = {r.doc_id for r in out.collect()}
        if name == "exact_dedup":
            best = {}
            for i, t in rows:
                plain = "".join(t.split())
                best[plain] = max(best.get(plain, (-1, 0)), (len(t), -i))
            assert kept == {-i for _, i in best.values()}
        if name == "near_dedup":
            assert kept == {i for i, (_, _, keep) in near_brute(rows, 5).items() if keep}
        if name == "decontamination":
            assert kept == {r[0] for r in contamination_brute(rows, benchmark) if not r[-1]}
        if name == "packing":
            assert kept == {i for i, _ in rows}
        else:
            assert out.columns == docs.columns and kept <= {i for i, _ in rows}
            docs = out
    assert len(kept) > 100


def test_rows_without_ids_and_repeated_rows(table, spark):
    docs = table([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "h i j k l m n"), (3, None)], "doc_id", "text")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DIR)
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect() if r.text) == [(0, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j k l m n")]


def test_empty_documents(table, spark):
    docs = table([], "doc_id", "text")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.collect() == []


def test_other_texts_under_a_copied_id_stay(table, spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (1, "a unique text of its own"), (1, long), (2, long + " end"), (3, "a  b c d e f")]
    docs = table(rows, "doc_id", "text")
    exact = corpus_pipeline.exact_dedup(spark, docs, DIR)
    assert sorted((r.doc_id, r.text) for r in exact.collect()) == sorted([rows[2], rows[3], rows[4], rows[5]])
    near = corpus_pipeline.near_dedup(spark, docs, DIR)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == sorted([rows[0], rows[2], rows[3]])


def test_a_named_row_is_kept_before_one_without_an_id(table, spark):
    docs = table([(None, "a  b  c"), (4, "a b c"), (2, "abc")], "doc_id", "text")
    assert [(r.doc_id, r.text) for r in corpus_pipeline.exact_dedup(spark, docs, DIR).collect() if r.doc_id] == [(4, "a b c")]
