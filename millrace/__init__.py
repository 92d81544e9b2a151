"""A small relational engine on Spark: SQL statements and a programmatic API over versioned DataFrames."""

__version__ = "0.1.0"
