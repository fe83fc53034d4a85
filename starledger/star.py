"""The three-table sales star every job reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starledger.sources.staging import stage


def dated_sales(sales: DataFrame) -> DataFrame:
    """Facts with an order date. Facts stored by year skip the folder of those without."""
    dated = sales.where(F.col("order_date").isNotNull())
    return dated.where(F.col("order_year").isNotNull()) if "order_year" in sales.columns else dated


@dataclass(frozen=True)
class Star:
    """Two dimensions and one fact, as DataFrames.

    Contract: a non-NULL ``customer_key`` / ``product_key`` occurs once in its
    dimension (the loaders check it). Nothing else is assumed: facts may carry
    unknown or NULL keys, and may lack an order date.

    ``derived`` says that the facts come out of joins. The reports, which resolve members at fact grain and pass
    over the result two or three times, then write the columns they need out first; stored facts are
    simply scanned again.
    """

    customers: DataFrame
    products: DataFrame
    sales: DataFrame
    derived: bool = False

    def for_passes(self, facts: DataFrame, columns: list[str]) -> DataFrame:
        """``facts``, taken from the sales of this star, ready to be read several times."""
        narrow = facts.select(*columns)
        return stage(narrow) if self.derived else narrow

    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_customers": self.customers,
            "dim_products": self.products,
            "fact_sales": self.sales,
        }

    def case_insensitive(self) -> Star:
        """The same star with texts that differ only in case taken as equal, in
        grouping, distinct counts, ranking and comparison. Which spelling a group
        shows is left open."""

        def fold(table: DataFrame) -> DataFrame:
            return table.select(
                *[F.collate(c, "UTF8_LCASE").alias(c) if t == "string" else c for c, t in table.dtypes]
            )

        return Star(*map(fold, (self.customers, self.products, self.sales)), self.derived)
