"""Spark-first analytics operators: every plan is declared with DataFrames or SQL."""
