"""Analytics over translated document collections, as Spark DataFrame operators."""
