from fixtures import layout, sample, titles
from leafwork.streaming.arrivals import convert_arrivals


def test_documents_are_converted_as_they_arrive(spark, tmp_path):
    book = layout(spark, sample(), titles())
    book.docs.select("doc_id").where("doc_id = 'sample'").write.parquet(str(tmp_path / "in"))
    arrived = spark.readStream.schema("doc_id string").parquet(str(tmp_path / "in"))
    convert_arrivals(arrived, book, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    made = spark.read.text(str(tmp_path / "out/batch=0/entry"), wholetext=True).collect()
    assert [r["slug"] for r in made] == ["sample"] and "Capítulo Um" in made[0]["value"]
