"""lodeline: a Spark-first analytics engine for query logs and text corpora."""

__version__ = "0.1.0"
