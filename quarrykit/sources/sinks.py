"""Report writers: each takes DataFrames and writes one text, JSON or CSV output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_object(answers: DataFrame, path: str) -> None:
    """A one-row table as a single JSON object."""
    answers.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv_report(rows: DataFrame, path: str, header: list[str] | None = None) -> None:
    """Rows with a header line; ``header`` renames the columns, blanks at their start included."""
    out = rows.toDF(*header) if header else rows
    out.coalesce(1).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)


def shown(items: Column) -> Column:
    """``('a', 'b')``; a single item as ``('a')``."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """(size, line): the itemsets of each size in order, comma separated, from an array column ``items``."""
    rows = itemsets.select(F.size("items").alias("size"), F.struct("items", shown(F.col("items")).alias("text")).alias("x"))
    return rows.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), ",").alias("line"))


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """``Candidates:`` and ``Frequent Itemsets:``, a line for each size, blank lines between."""
    parts = []
    for k, (title, rows) in enumerate((("Candidates: ", candidates), ("Frequent Itemsets: ", frequent))):
        head = rows.sparkSession.range(1).select(F.lit(k).alias("part"), F.lit(0).alias("size"), F.lit(title).alias("line"))
        parts.append(head.unionByName(itemset_lines(rows).select(F.lit(k).alias("part"), "size", F.concat("line", F.lit("\n")).alias("line"))))
    text = parts[0].unionByName(parts[1]).coalesce(1).sortWithinPartitions("part", "size")
    text.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def community_report(communities: DataFrame, path: str) -> None:
    """One community a line, members quoted, smaller communities first, from an array column ``members``."""
    line = F.concat(F.lit("'"), F.array_join("members", "', '"), F.lit("'"))
    communities.select(F.size("members").alias("n"), "members", line.alias("value")).coalesce(1).sortWithinPartitions("n", "members").select("value").write.mode("overwrite").text(path)


def betweenness_report(edges: DataFrame, path: str) -> None:
    """``('u', 'v'),value`` with the largest value first, from (u, v, betweenness)."""
    line = F.format_string("('%s', '%s'),%s", "u", "v", F.round("betweenness", 5))
    edges.coalesce(1).sortWithinPartitions(F.desc("betweenness"), "u", "v").select(line.alias("value")).write.mode("overwrite").text(path)


def cluster_report(rounds: DataFrame, labels: DataFrame, path: str) -> None:
    """The rounds' counts, then ``id,label``: from (round, n_ds, n_ccs, n_cs, n_rs) and (id, cluster)."""
    head = rounds.select(F.lit(0).alias("part"), F.col("round").cast("long").alias("k"), F.format_string("Round %d: %d,%d,%d,%d", "round", "n_ds", "n_ccs", "n_cs", "n_rs").alias("value"))
    tail = labels.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("k"), F.concat_ws(",", "id", "cluster").alias("value"))
    head.unionByName(tail).coalesce(1).sortWithinPartitions("part", "k").select("value").write.mode("overwrite").text(path)
