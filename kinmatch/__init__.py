"""kinmatch: record linkage and corpus processing expressed as Spark DataFrame plans."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
