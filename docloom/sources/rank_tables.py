"""Stored sort orders: pages of queries without words are found by counts, not by a sort.

For each order the narrow rows ``(doc_id, file_type)`` are stored in range partitions: every row of a
part comes before all rows of the next one, and rows carry their place in the part. A table of counts
says how many rows of each type a part has. A page of some types lies in the one or two parts in
which the running count passes its rows, and only those are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom import constants as C
from docloom.operators.search import SORTS, sort_columns

#: Orders that are stored; relevance is another one for each query.
ORDERS = tuple(o for o in SORTS if o != "relevance")
ROWS_PER_PART = 1_000_000


@dataclass(frozen=True)
class RankTables:
    spark: SparkSession
    path: str

    def _rows(self, id_type: str) -> DataFrame:
        schema = f"doc_id {id_type}, file_type string, at bigint, sort string, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def _counts(self) -> DataFrame:
        schema = "sort string, part int, file_type string, n bigint, id_type string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/counts")

    def total(self, types: Sequence[str] = ()) -> int:
        """How many documents there are of these types, or of all."""
        some = self._counts().where(F.col("sort") == ORDERS[0])
        some = some.where(F.col("file_type").isin(*types)) if types else some
        return some.agg(F.sum("n")).first()[0] or 0

    def page(self, order: str, types: Sequence[str] = (), number: int = 1, size: int = C.PAGE_SIZE) -> DataFrame:
        """``(doc_id, rank)`` of one page of all documents of these types, or of all documents."""
        counts = self._counts().where(F.col("sort") == order)
        counts = counts.where(F.col("file_type").isin(*types)) if types else counts
        # a row for each part: the collection's rows by a million
        parts = counts.groupBy("part").agg(F.sum("n").alias("n"), F.first("id_type").alias("id_type")).orderBy("part").collect()
        first, last = (max(number, 1) - 1) * size + 1, max(number, 1) * size
        before, wanted = 0, []
        for p in parts:
            if before < last and before + p["n"] >= first:
                wanted.append((p["part"], before))
            before += p["n"]
        rows = self._rows(parts[0]["id_type"] if parts else "bigint")
        rows = rows.where((F.col("sort") == order) & F.col("part").isin(*[p for p, _ in wanted]) if wanted else F.lit(False))
        rows = rows.where(F.col("file_type").isin(*types)) if types else rows
        start = F.lit(0)
        for part, so_far in wanted:
            start = F.when(F.col("part") == part, so_far).otherwise(start)
        place = F.row_number().over(Window.partitionBy("part").orderBy("at"))  # over one page's parts
        ranked = rows.withColumn("rank", (start + place).cast("bigint"))
        return ranked.where(F.col("rank").between(first, last)).select("doc_id", "rank")


def write_ranks(meta: DataFrame, path: str, rows_per_part: int = ROWS_PER_PART) -> RankTables:
    """Store the orders of ``meta`` (the search columns without texts) below a new or old ``path``."""
    spark, id_type = meta.sparkSession, meta.schema["doc_id"].dataType.simpleString()
    parts = -(-meta.count() // rows_per_part) or 1
    for mode, order in zip(("overwrite", *["append"] * len(ORDERS)), ORDERS):
        keys = sort_columns(order)
        ordered = meta.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        at = F.monotonically_increasing_id()  # grows along each part
        rows = ordered.select(
            "doc_id", "file_type", at.alias("at"), F.lit(order).alias("sort"), F.spark_partition_id().alias("part")
        )
        rows.write.mode(mode).partitionBy("sort", "part").parquet(f"{path}/rows")
    ranks = RankTables(spark, path)
    counts = ranks._rows(id_type).groupBy("sort", "part", "file_type").agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("id_type", F.lit(id_type)).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    return ranks
