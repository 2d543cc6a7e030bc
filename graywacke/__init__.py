"""Analytics on Spark DataFrames: logs, audits, statistics, signals and document checks."""
