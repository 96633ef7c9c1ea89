"""Analytics of parsed business documents on Spark: elements, tables, chunks, scores, standards and metrics."""
