"""Conversion of documents as they arrive.

Analysis needs whole documents, so a stream of layout tables is handled by micro-batches of
document ids: each batch converts the documents that its ids name, from the tables at rest. A
batch's ids are put into the scans, so that tables partitioned or sorted by document are read only where
these documents are; a batch of very many ids is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwork.plans.convert import Layout, Options, convert, write


#: Ids of a batch that are put into the scans at most.
MOST_IDS = 2000


def _only(df: DataFrame, ids: DataFrame, named: list[str]) -> DataFrame:
    return df.where(F.col("doc_id").isin(named)) if len(named) <= MOST_IDS else df.join(ids, "doc_id", "left_semi")


def convert_arrivals(arrived: DataFrame, layout: Layout, path: str, checkpoint: str, options: Options = Options(), once: bool = False) -> StreamingQuery:
    """Starts a query over a stream of doc_id; a document that arrives again is written again."""

    def run(batch: DataFrame, number: int) -> None:
        ids = batch.select("doc_id").where("doc_id is not null").distinct()
        named = [r[0] for r in ids.limit(MOST_IDS + 1).collect()]
        some = Layout(**{k: _only(df, ids, named) for k, df in vars(layout).items()})
        write(convert(some, options), f"{path}/batch={number}")

    writer = arrived.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
