"""Sales star-schema analytics as Spark DataFrame jobs."""

from starledger.star import Star

__all__ = ["Star"]
