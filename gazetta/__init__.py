"""Analytics over semi-structured notices, expressed as Spark DataFrame and Column transformations."""
