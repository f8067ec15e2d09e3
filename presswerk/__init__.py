"""presswerk: a Spark-first engine for news records, story clusters and reader briefs."""

__version__ = "0.1.0"
