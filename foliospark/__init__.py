"""foliospark: document ingestion, text cleaning and hybrid retrieval on Spark DataFrames."""

__version__ = "0.1.0"
