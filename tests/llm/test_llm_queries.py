"""The queries and the pipeline over the smallest tables."""

import pytest

import corpus_pipeline
from conftest import twin
from leafwork.llm import pii, queries
from test_operators import plain_components, shingles


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(name, spark, sf_dir):
    twin(queries.QUERIES[name], queries.ORACLE[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_labels_of_documents_say_nothing_on_urls(spark, tmp_path):
    hosts = ["www.quiet.example.com"] * 20 + ["blog.still.example.org"] * 20 + ["www.free-casino.example.com"] * 5
    spark.createDataFrame([(i, f"https://{h}/en/{i}") for i, h in enumerate(hosts)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i >= 20), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.op5_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i >= 40 else "allow" for i in range(45)}


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [r for r in docs if r["text"] and any(c.isalpha() for c in r["text"])]
    labels = {kept[i]["doc_id"]: kept[k]["doc_id"] for i, _, k in plain_components([r["text"] for r in kept])}
    kept = [r for r in kept if labels[r["doc_id"]] == r["doc_id"]]
    kept = [r for r in kept if not any(4 * len(shingles(r["text"]) & s) >= 3 * len(s) for s in items)]
    want = {r["doc_id"]: pii.mask(r["text"], pii.find(r["text"])) for r in kept}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["lossless"] for r in got)
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_over_long_texts_and_clashing_names(spark, sf_dir):
    long = " ".join(f"word{i % 977} and the other {i % 13}" for i in range(30_000))
    rows = [(1, long, "en", "s", 0, "a", 1), (2, long, "en", "s", 0, "b", 2), (3, long + " more", "en", "s", 0, "c", 3), (4, "quite another text, mail me at a.b@example.com", "en", "s", 0, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, id int")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {1, 4} and got[1]["lossless"] and got[1]["n_tokens"] == len(got[1]["ids"]) > 90_000 and "@" not in got[4]["text"]


def test_pipeline_over_odd_rows(spark, sf_dir, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Hello there my friend of old", None, None, None), (None, "a text without an id at all", "en", "s", 1), (3, "Hello there my friend of old", None, None, None)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() == (3 if part else 0)
