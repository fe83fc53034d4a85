"""Top-k and whole-table ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starledger.functions.semantics import asc, desc, int_div
from starledger.sources.staging import stage


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows: each task keeps its own best ``n``, nothing is sorted whole."""
    return df.orderBy(*order).limit(n)


def top_ranked(df: DataFrame, value: str, ranks: int, rank_name: str) -> DataFrame:
    """Rows holding one of the ``ranks`` largest distinct values, all ties kept.

    The winning values are found first and joined back, so a value shared by a
    large part of the rows stays spread over its tasks.
    """
    best = df.select(F.col(value).alias("_value")).distinct().orderBy(*desc("_value")).limit(ranks)
    # One row per rank from here on: at most `ranks` rows.
    numbered = best.select(
        "_value", F.row_number().over(Window.orderBy(*desc("_value"))).cast("long").alias(rank_name)
    )
    return df.join(F.broadcast(numbered), F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def rank_values(df: DataFrame, value: str, rank_name: str) -> DataFrame:
    """Dense rank of a per-group count, largest first, through its distinct values.

    The values are ranked in slices, and Spark's own size check decides how they join.
    """
    values = df.select(F.col(value).alias("value")).distinct()
    ranked = SlicedOrder(values, "value", []).ranked(rank_name).withColumnRenamed("value", "_value")
    same = F.col(value).eqNullSafe(F.col("_value"))
    return df.join(ranked, same, "left").drop("_value")


class SlicedOrder:
    """A frame in descending order of one value, cut into slices and staged.

    A window without partition keys would send every row to one task. Here a
    range shuffle on (value, tie-break) cuts the order into even slices, so one
    value shared by many rows is cut as well. Ranks are taken inside each slice
    and shifted by what lies before it. The shifts come from one row per slice.

    The slices are written once to the staging folder: their bounds come from
    sampling and must not move between the two passes, and the facts behind the
    frame are then read only once.
    """

    def __init__(self, df: DataFrame, value: str, tie_break: list[str], within: str | None = None):
        self.value, self.within = value, within
        order = [*desc(value), *asc(*tie_break)]
        slice_window = Window.partitionBy("_slice")
        sliced = (
            df.repartitionByRange(*order)
            .withColumn("_slice", F.spark_partition_id())
            .withColumn("_position", F.row_number().over(slice_window.orderBy(*order)))
            .withColumn("_rank", F.dense_rank().over(slice_window.orderBy(*desc(value))))
        )
        if within is not None:
            inner = Window.partitionBy("_slice", within).orderBy(*desc(value))
            sliced = sliced.withColumn("_inner_rank", F.dense_rank().over(inner))
        self.rows = stage(sliced)

    def _edges(self, keys: list[str], local_rank: str) -> DataFrame:
        """First and last value, and number of distinct values, of each piece."""
        x = F.col(self.value)
        has_null = F.count(F.lit(1)) > F.count(x)
        return self.rows.groupBy(*keys).agg(
            F.max(x).alias("_first"),
            F.when(~has_null, F.min(x)).alias("_last"),
            F.max(local_rank).cast("long").alias("_distinct"),
            F.count(F.lit(1)).alias("_count"),
            F.sum(x).alias("_sum"),
        )

    @staticmethod
    def _ranks_before(previous_pieces) -> Column:
        """Distinct values in earlier pieces, less one per value cut by a piece edge."""
        earlier = previous_pieces.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_distinct").over(earlier), F.lit(0)) - F.sum(
            F.col("_continues").cast("long")
        ).over(previous_pieces.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    @staticmethod
    def _with_continues(edges: DataFrame, pieces) -> DataFrame:
        return edges.withColumn(
            "_continues",
            (F.row_number().over(pieces) > 1)
            & F.col("_first").eqNullSafe(F.lag("_last").over(pieces)),
        )

    def ranked(
        self,
        rank: str,
        total: str | None = None,
        within_rank: str | None = None,
        ntiles: dict[str, int] | None = None,
    ) -> DataFrame:
        """Rows with a whole-table dense rank, and on request the grand total of
        the value, the dense rank inside ``within``, and equal-sized tiles."""
        # One row per slice; there are never more slices than shuffle partitions.
        pieces = Window.orderBy("_slice")
        everything = pieces.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        earlier = pieces.rowsBetween(Window.unboundedPreceding, -1)
        shifts = self._with_continues(self._edges(["_slice"], "_rank"), pieces).select(
            "_slice",
            self._ranks_before(pieces).alias("_ranks_before"),
            F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_rows_before"),
            F.sum("_count").over(everything).alias("_all_rows"),
            F.sum("_sum").over(everything).alias("_all_sum"),
        )
        out = self.rows.join(F.broadcast(shifts), "_slice")
        added = [(F.col("_rank") + F.col("_ranks_before")).alias(rank)]
        if total is not None:
            added.append(F.col("_all_sum").alias(total))
        position = F.col("_position") + F.col("_rows_before")
        added += [
            tile(position, F.col("_all_rows"), k).alias(name) for name, k in (ntiles or {}).items()
        ]
        if within_rank is not None:
            out = out.join(
                self._inner_shifts(),
                (out["_slice"] == F.col("_shift_slice"))
                & out[self.within].eqNullSafe(F.col("_shift_within")),
            )
            added.append((F.col("_inner_rank") + F.col("_inner_before")).alias(within_rank))
        kept = [c for c in self.rows.columns if not c.startswith("_")]
        return out.select(*kept, *added)

    def _inner_shifts(self) -> DataFrame:
        """Shift per (slice, group): a group has at most one row per slice here."""
        pieces = Window.partitionBy(self.within).orderBy("_slice")
        edges = self._edges(["_slice", self.within], "_inner_rank")
        return self._with_continues(edges, pieces).select(
            F.col("_slice").alias("_shift_slice"),
            F.col(self.within).alias("_shift_within"),
            self._ranks_before(pieces).alias("_inner_before"),
        )


def tile(position: Column, rows: Column, k: int) -> Column:
    """Tile 1..k of a 1-based position: the first ``rows % k`` tiles get one row more."""
    size, larger = int_div(rows, F.lit(k)), rows % k
    in_larger = larger * (size + 1)
    return F.when(position <= in_larger, int_div(position - 1, size + 1) + 1).otherwise(
        larger + int_div(position - 1 - in_larger, size) + 1
    )
