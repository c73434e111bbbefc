"""skerry: a Spark-first document retrieval and corpus-preparation engine."""

__version__ = "0.1.0"
