"""complexa: a Spark-native engine for labelled code corpora and prediction scoring."""

__version__ = "0.1.0"
