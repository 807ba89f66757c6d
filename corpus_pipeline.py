"""A corpus pipeline out of the operators of quarrykit.llm: each stage takes documents and returns documents.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs`` and whole rows of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.llm import toxicity
from quarrykit.llm.common import stored, table, with_rank
from quarrykit.llm.decontaminate import leaks
from quarrykit.llm.mixing import mixed
from quarrykit.llm.near_dups import near_duplicates
from quarrykit.llm.sharding import proportional_shards

SHARDS = 40


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a classifier trained on the labelled documents rejects. A null text is scored as an empty one."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id (of rows that repeat this id, one).
    Rows that repeat an id with unlike texts are documents of their own. Empty texts and rows without an id stay."""
    found = near_duplicates(docs).where("group_id is not null")
    first = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    named = docs.withColumn("_text_hash", F.xxhash64("text"))
    one = named.join(first, (F.col("doc_id") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    # What has no words has no group.
    rest = named.where("doc_id is null or text is null or not text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return one.unionByName(rest).select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, with its own values or others."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"] == found["_leak"], "left_anti")


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted by their place in the mixture; rows without an id follow in no order of their own. Rows that
    repeat an id in a source take that id's places there, one each."""
    named = docs.where("doc_id is not null")
    place = mixed(named).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("position").alias("_place"))
    place = place.withColumn("_m", F.row_number().over(Window.partitionBy("_id").orderBy("_source", "_place"))).drop("_source")
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("source", F.xxhash64(*docs.columns))))
    rows = named.join(place, (F.col("doc_id") == F.col("_id")) & (F.col("_n") == F.col("_m"))).select(*docs.columns, "_place")
    rows = rows.unionByName(docs.where("doc_id is null").withColumn("_place", F.lit(None).cast("long")))
    return rows.orderBy(F.col("_place").asc_nulls_last()).select(*docs.columns)


def _stored_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_order``, 32 hex digits that rise along the part files of the table and the rows in each."""
    part = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long")
    rows = docs.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    rows = with_rank(rows, [], F.expr("_part * 1048576 + _row div 4096"), ["_part", "_row"], "_place")
    return rows.withColumn("_order", F.expr("concat(lpad(hex(_place * 4096 div _place_of), 3, '0'), lpad(hex(_place), 29, '0'))"))


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document and its slot there; every shard matches the sources' mixture, and the documents of a
    source are dealt in the order in which ``docs`` was stored, that of the mixture."""
    rows = _stored_order(docs.select("doc_id", "text", "source", "_metadata"))
    return proportional_shards(rows, SHARDS, key="_order").select("doc_id", "source", "size", "text_crc32", "position", "shard", "slot")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_leaks),
    ("mixing", in_mixed_order),
    ("sharding", into_shards),
]

#: A trained classifier can't be written as SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
