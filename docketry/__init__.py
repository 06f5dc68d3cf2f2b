"""Case-retrieval analytics on Spark: query cases, candidate cases, scored and judged runs."""
