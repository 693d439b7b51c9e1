"""Registered checks: each builds its input from the given tables with Spark
(so the work grows with them), runs a ledgerloom operator and returns a
DataFrame; ``ORACLES`` holds the equivalent DuckDB SQL over the same tables."""
