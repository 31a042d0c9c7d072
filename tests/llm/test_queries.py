"""The registered queries beside their SQL, and the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from check import compare, connect
from tablestory.llm import catalog, latent_search, ngram_join

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, FOLDER), connect(FOLDER), catalog.SQL[name]) is None


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER).checkpoint()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        sizes.append(out.count())
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[-1] > sizes[0] / 2
    assert latent_search.find_items(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    assert ngram_join.ngram_components(docs, size=5, percent=80).where("component_id <> doc_id").count() == 0
    packed = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r.doc_id for r in packed.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def odd(spark, *rows):
    """Documents without lang and source, with columns named like those that the stages make."""
    made = [(k, t, 5, "x", 1, [k or 0]) for k, t in rows]
    return spark.createDataFrame(made, "doc_id bigint, text string, n_lines int, `n_dropped` string, bucket int, carried array<bigint>")


def prose(k, n=80):
    return " ".join(f"word{(k * 31 + i * 7) % 997} and" for i in range(n))


def test_stages_take_odd_tables(spark):
    rows = [(1, prose(1)), (2, prose(2)), (2, prose(2)), (None, prose(3)), (None, None), (4, ""), (5, " \t\n"), (6, prose(1)), (7, None), (8, "w " * 60_000)]
    docs = odd(spark, *rows, *[(100 + k, prose(k + 50) + "\nthis line is found in many documents\n" + prose(k + 90)) for k in range(5)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert all(r.n_lines == 5 and r.n_dropped == "x" and r.carried == [r.doc_id or 0] for r in kept)
    assert corpus_pipeline.batches(spark, docs, FOLDER).count() == docs.count()


def test_own_lines_keeps_every_row(spark):
    line = "this line is found in many documents"
    docs = odd(spark, *[(k, f"own {k}\n{line}\nend {k}") for k in range(5)], (9, None), (4, line))
    out = corpus_pipeline.own_lines(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [*[(k, f"own {k}\nend {k}") for k in range(4)], (4, f"own 4\n{line}\nend 4"), (4, line), (9, "")]


def test_one_row_of_each_id_and_group_stays(spark):
    same, other = prose(1), prose(40)
    docs = odd(spark, (5, same), (5, same), (3, same), (3, same), (8, other), (8, "other words here"), (None, same), (None, same), (9, None), (9, None))
    out = corpus_pipeline.one_of_each(spark, docs, FOLDER).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "8", "9", "None", "None"]
    twice = docs.union(docs)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each(spark, twice, FOLDER).collect()) == ["3", "8", "9", "None", "None", "None", "None"]
