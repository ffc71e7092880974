"""Every operator and every stage on odd and on empty tables."""

import sys
from collections import Counter

import pytest

from docloom.llm import decontaminate, html_extract, langid_ecoc, line_spread, quality_nbsvm, repetition, secret_ledger, simhash_gph, temperature_mix, token_counts

LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"


def apply(spark, name, docs):
    import public_tokenizers

    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, None), (5, None, None), (99, 0, 0), (4, 1, 0)], LABELS)
    bench = spark.createDataFrame([(1, "near the river bank while seven birds watch from a tall old tree"), (None, None), (2, "")], BENCH)
    return {
        "2": lambda: token_counts.op2(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "3": lambda: quality_nbsvm.op3(docs, labels),
        "4": lambda: decontaminate.op4(docs, bench),
        "5": lambda: secret_ledger.op5(docs),
        "6": lambda: repetition.op6(docs),
        "7": lambda: langid_ecoc.op7(docs),
        "8": lambda: temperature_mix.op8(docs),
        "9": lambda: line_spread.op9(docs),
        "10": lambda: simhash_gph.op10(docs),
    }[name]()


NAMES = ["2", "3", "5", "6", "7", "8", "9", "10"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_table_keeps_every_row(spark, odd_docs, name):
    got = apply(spark, name, odd_docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd_docs.collect())


def test_odd_table_decontamination(spark, odd_docs):
    assert {r.doc_id for r in apply(spark, "4", odd_docs).collect()} == {4, 5}


@pytest.mark.parametrize("name", [*NAMES, "4"])
def test_empty_table(spark, no_docs, name):
    assert apply(spark, name, no_docs).count() == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "", "", "x"), (1, "", "", "x"), (2, "no url", "<p>a" * 3000, "x"), (3, "http://h/", "<div>" * 3000 + "deep" + "</div>" * 3000, "x")], "page_id long, url string, html string, host string")
    got = html_extract.op1(pages).collect()
    assert Counter(r.page_id for r in got) == Counter([None, 1, 1, 2, 3]) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[3] == "deep"
    assert html_extract.op1(pages.limit(0)).count() == 0


def test_very_many_sources(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('own words of number ', id, char(10), 'a line of all') AS text", "concat('s', id) AS source", "'en' AS lang")
    got = temperature_mix.op8(docs)
    assert got.count() == 4000 and got.where("copies >= 1").count() == 4000
    assert line_spread.op9(docs).where("n_removed = 1 AND text NOT LIKE '%a line of all%'").count() == 4000


def test_one_text_and_one_null_on_a_third_of_the_rows(spark):
    """Hot keys of the joins on texts: every row comes back, with what one copy alone would get."""
    import public_tokenizers

    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'token=abcdef12 and the same words' WHEN id % 3 = 1 THEN concat('words of ', id) END AS text", "concat('s', id % 20) AS source")
    tokens = token_counts.op2(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.count() == 6000 and {r.n_tokens for r in tokens.where("doc_id % 3 = 2").collect()} == {0} and len({r.n_tokens for r in tokens.where("doc_id % 3 = 0").collect()}) == 1
    assert {(r.doc_id % 3, r.n_assign) for r in secret_ledger.op5(docs).collect()} == {(0, 1), (1, 0), (2, 0)}
    assert {(r.doc_id % 3, r.n_removed) for r in line_spread.op9(docs).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert simhash_gph.op10(docs).where("doc_id % 3 = 0").select("component_id").distinct().count() == 1


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        simhash_gph.op10(spark.range(1))


def test_pipeline_stages(spark, odd_docs, no_docs, tmp_path):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import corpus_pipeline

    (bench := spark.createDataFrame([(1, "a b c d e f g h")], BENCH)).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert bench.count() == 1
    for n, docs in enumerate((odd_docs, no_docs)):
        ids = {r.doc_id for r in docs.collect()}
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{tmp_path}/{n}-{name}"
            got = stage(spark, docs, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
            got.write.parquet(out)
            docs = spark.read.parquet(out)
            assert {r.doc_id for r in docs.collect()} <= ids


def test_pipeline_result(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in got}) == len(got) <= docs.count()
    bad = {r.doc_id for r in decontaminate.op4(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert not bad & {r.doc_id for r in got}
