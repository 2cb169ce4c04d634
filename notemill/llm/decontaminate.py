"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

An item is contained in a document when the share of the item's distinct word shingles that the document has reaches a
threshold. Documents are far longer than items, so the search is asymmetric: only items are sketched, and a document is
searched for with all its shingles.

* Items are partitioned by size: class c holds items of 2 ** c to 2 ** (c + 1) - 1 distinct shingles. Each class has its
  own sketch width k: the items of a class are stood for by their k shingles of lowest hash (a bottom-k MinHash sketch).
  A document searches the classes whose smallest item it has shingles enough to contain.
* k is one more than the shingles that the largest item of the class may lack at the threshold. So every document that
  contains an item has at least one shingle of its sketch: candidates are complete, not probable.
* Candidates are verified by the exact containment of the shingles themselves.

A text of fewer words than a shingle is, as a whole, its only shingle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, THRESHOLD = 5, 0.8


def words_of(text):
    """Lower-case words between ASCII white space; null: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingles_of(words, size: int):
    """The shingles of size words as strings, repeats included."""
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, length (words of a shingle: size, or all of a shorter item), shingles (distinct), class (of their number),
    k, sketch (hashes). Items without a word are left out."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    words = words.withColumn("length", F.least(F.size("words"), F.lit(size)))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.slice("words", i, F.col("length")))
    out = words.select("item_id", "length", F.array_distinct(cut).alias("cut"))
    out = out.withColumn("class", F.length(F.bin(F.size("cut").cast("long"))) - 1)
    top = F.pow(F.lit(2), F.col("class") + 1) - 1
    out = out.withColumn("k", (F.floor(top * (1 - threshold) + 1e-9) + 1).cast("int"))
    sketch = F.slice(F.array_sort(F.transform("cut", lambda s: F.xxhash64(s))), 1, F.col("k"))
    return out.select("item_id", "length", F.transform("cut", lambda s: F.array_join(s, " ")).alias("shingles"), "class", "k", sketch.alias("sketch"))


def candidates(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id (distinct) of the documents that have a shingle of the item's sketch. items: item_table(). Of each
    size class a document searches only those whose smallest item it has shingles enough to contain."""
    need = F.floor(F.pow(F.lit(2), F.col("class")) * threshold - 1e-9)
    index = common.staged(items.select("length", "item_id", need.alias("need"), F.explode("sketch").alias("h")).distinct(), "sketches")
    lengths = sorted(r[0] for r in index.select("length").distinct().collect())  # SHINGLE values at most
    index = common.sized(index)
    words = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    found = None
    for n in lengths:
        at = words.where(F.size("words") >= n).select("doc_id", "words", F.explode(F.sequence(F.lit(1), F.size("words") - (n - 1))).alias("i"))
        own = at.select("doc_id", F.xxhash64(F.slice("words", F.col("i"), n)).alias("h"), (F.size("words") - (n - 1)).alias("has"))
        own = own.join(index.where(F.col("length") == n), "h").where("has >= need").select("doc_id", "item_id")
        found = own if found is None else found.union(own)
    if found is None:
        kinds = [docs.schema[id_col].dataType, items.schema["item_id"].dataType]
        found = docs.sparkSession.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in zip(("doc_id", "item_id"), kinds)]))
    return common.staged(found.distinct(), "candidates")


def contained(docs: DataFrame, items: DataFrame, found: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found of the verified candidates."""
    texts = docs.select(F.col(id_col).alias("d"), words_of(F.col(text_col)).alias("words"))
    met = texts.join(common.sized(found), F.col("d").eqNullSafe(F.col("doc_id"))).join(common.sized(items.select("item_id", "length", "shingles"), items), "item_id")
    own = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1), lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))
    n = F.when(F.size("words") >= F.col("length"), F.size(F.array_intersect("shingles", own))).otherwise(0)
    out = met.select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), n.alias("n_found"))
    return out.where(F.col("n_found") >= F.col("n_shingles") * F.lit(threshold) - 1e-9)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and benchmark item it contains: doc_id, item_id, n_shingles, n_found (long), containment.

    Null and empty texts contain nothing and are contained in nothing. Rows with a null id count as one document of id
    null; of rows that repeat a document id, the one that has most of an item counts. Empty tables give no rows."""
    items = common.staged(item_table(benchmark, item_col, item_text_col, size, threshold), "items")
    out = contained(docs, items, candidates(docs, items, id_col, text_col, threshold), id_col, text_col, threshold)
    out = out.groupBy("doc_id", "item_id").agg(F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_found").cast("long").alias("n_found"))
    return out.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text contains a benchmark item. Each row is judged by its own text, whatever its id: rows
    that share an id, or have none, go or stay one by one."""
    key = F.struct(F.xxhash64(text_col).alias("h"), F.length(text_col).alias("n"))
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("doc_id"), F.col(text_col).alias("text"))
    gone = contamination(texts, benchmark, size=size, threshold=threshold).select(F.col("doc_id").alias(common.free_name(docs, "gone"))).distinct()
    gone = common.staged(gone, "contaminated")
    return docs.join(common.sized(gone), key == gone[gone.columns[0]], "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM benchmark),
bi AS (SELECT item_id, words, least(5, len(words)) AS n FROM b WHERE len(words) > 0),
bs AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS s FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM bi)),
size AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1),
lens AS (SELECT DISTINCT n FROM bs),
ds AS (SELECT doc_id, n, array_to_string(words[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lens WHERE len(words) >= n))
SELECT doc_id, bs.item_id, n_shingles, count(DISTINCT bs.s) AS n_found, round(count(DISTINCT bs.s) / n_shingles, 6) AS containment
FROM ds JOIN bs USING (n, s) JOIN size ON size.item_id = bs.item_id
GROUP BY doc_id, bs.item_id, n_shingles HAVING count(DISTINCT bs.s) >= 0.8 * n_shingles - 1e-9
"""
