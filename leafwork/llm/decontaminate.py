"""Benchmark decontamination: items found inside long documents, with DataFrame functions only.

Containment is asymmetric, so documents aren't sketched: all their shingles probe an index of
item sketches. Items fall into partitions by the size of their shingle set, one for each size; an
item of n shingles is sketched by its n - ceil(0.75 n) + 1 smallest hashes (bottom-k MinHash, k
fixed by the partition). A document that holds 75 % of the item's shingles misses fewer than k of them, so it
holds one of the sketch: the search loses nothing. Candidates are verified on the words
themselves: the share of the item's distinct shingles that stand in the document.

Words are runs without blanks, lower-cased; a shingle is five words, or the whole sequence of a
shorter text. An item of fewer words is thus found only in a document of just these words.

Edge cases: null or empty texts have no shingles and match nothing; rows without an id take no
part; repeated rows give one result per pair of ids, that of the best contained text if an item's
id has several; texts are whole; other columns are ignored
by ``find``, and ``clean`` keeps them; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

SHINGLE = 5
LEAST_PERCENT = 75
#: Bytes of a table that is broadcast at most; larger ones are shuffled.
BROADCAST_BYTES = 32_000_000


def small(df: DataFrame, *sized: Column) -> DataFrame:
    """The table, to be broadcast if its rows (8 bytes a column, and the sizes told) are few enough."""
    row = F.lit(8 * len(df.columns)) + sum((F.coalesce(c, F.lit(0)) for c in sized), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\t-\r]+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row (a lambda variable is never inlined)."""
    return F.get(F.transform(F.array(value), body), 0)


def _shingles(w: Column, one) -> Column:
    """one(words) for each five words in a row, or for the whole sequence if it is shorter; null without words."""
    every = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: one(*(F.get(w, i + k) for k in range(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, every).when(F.size(w) > 0, F.array(one(*(F.coalesce(F.get(w, F.lit(k)), F.lit("")) for k in range(SHINGLE)))))


def hashes(text: Column) -> Column:
    """Hashes of a text's shingles, repeated as they come."""
    return let(words(text), lambda w: _shingles(w, F.xxhash64))


def texts(text: Column) -> Column:
    """A text's distinct shingles, each with a blank before and after it."""
    return F.array_distinct(let(words(text), lambda w: _shingles(w, lambda *x: F.concat(F.lit(" "), F.rtrim(F.concat_ws(" ", *x)), F.lit(" ")))))


def sketches(items: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """Rows (hash, item_id): of each item as many smallest hashes as its size asks for."""
    least = lambda s: F.size(s) - F.floor((F.size(s) * percent + 99) / F.lit(100)).cast("int") + 1
    own = let(F.array_sort(F.array_distinct(hashes(F.col("text").cast("string")))), lambda s: F.slice(s, F.lit(1), least(s)))
    return items.select("item_id", F.explode(own).alias("hash")).distinct()


def candidates(docs: DataFrame, items: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """Pairs (doc_id, item_id) that share a sketched shingle: all that can reach the share."""
    index = sketches(items, percent)
    probes = docs.select("doc_id", F.explode(hashes(F.col("text").cast("string"))).alias("hash"))
    return probes.join(small(index, F.octet_length(F.col("item_id").cast("string"))), "hash").select("doc_id", "item_id").distinct()


def find(docs: DataFrame, items: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """Pairs of document and item with n_item (shingles of the item), n_shared, and containment."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    # Few documents are candidates: their ids go to the texts, not the texts to a shuffle.
    pairs = small(saved(candidates(docs, items, percent), "candidates"))
    # An id's texts are items of their own, as in their sketches.
    own = items.select("item_id", F.array_sort(texts(F.col("text").cast("string"))).alias("shingles")).where("shingles is not null").distinct()
    own = small(own, F.aggregate("shingles", F.lit(0), lambda n, x: n + F.octet_length(x) + 16))
    found = docs.join(pairs, "doc_id").join(own, "item_id")
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    # A shingle of fewer words is a whole text: it has to be the document's whole text too.
    held = let(padded(words(F.col("text").cast("string"))), lambda t: F.size(F.filter("shingles", lambda s: F.contains(t, s) & ((F.size(F.split(s, " ")) == SHINGLE + 2) | (t == s)))))
    found = found.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), held.cast("long").alias("n_shared"))
    found = found.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", "best.containment")


def clean(docs: DataFrame, items: DataFrame, percent: int = LEAST_PERCENT) -> DataFrame:
    """The documents that hold no item, with all their columns; rows without an id stay."""
    hit = saved(find(docs, items, percent).select("doc_id").distinct(), "hits")
    return docs.join(small(hit), "doc_id", "left_anti").select(docs.columns)


_SHINGLES = """CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END"""
ORACLE = f"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
i0 AS (SELECT item_id, {_SHINGLES} AS s FROM iw),
i1 AS (SELECT item_id, len(s) AS n_item, unnest(s) AS s FROM i0),
d1 AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM dw)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d1 JOIN i1 USING (s) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * {LEAST_PERCENT}
"""
