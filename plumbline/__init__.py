"""plumbline: a Spark-native engine that checks whether what a data catalog says is true."""

__version__ = "0.1.0"
