"""Portfolio-research and market-data analytics as long-format Spark DataFrame operators."""

__version__ = "0.1.0"
