"""anamnex: a Spark-native analytics engine for longitudinal health records."""

__version__ = "0.1.0"
