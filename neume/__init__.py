"""neume: a Spark-first analytics engine over recognised tokens, page geometry and symbol sequences."""

__version__ = "0.1.0"
