"""quillspark: a Spark-native engine for ranked observations, document snapshots, labels and vectors."""

__version__ = "0.1.0"
