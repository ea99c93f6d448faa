"""lodestone: table profiling, query judging and SQL-dialect tools on Spark DataFrames."""

__version__ = "0.1.0"
