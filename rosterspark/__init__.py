"""rosterspark: curation of people/office records as Spark DataFrame transforms."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
