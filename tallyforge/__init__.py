"""Spark-first analytics for contest-style data: DataFrame operators, text sources, streaming."""
