"""Analytics over repeat-visit histories, written as Spark DataFrame jobs."""

from visitwise.operators.histories import Histories, Keys

__all__ = ["Histories", "Keys"]
