"""basaltic: a Spark-native engine for corpora of program artefacts and text."""

__version__ = "0.1.0"
