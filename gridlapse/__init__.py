"""Power-trace analytics expressed as plain Spark DataFrame operators."""

__version__ = "0.1.0"
