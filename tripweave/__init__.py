"""PySpark-native processing and summaries for travel-model output and travel surveys."""

from tripweave.model import Config, GeographyAggregation, Run

__all__ = ["Config", "GeographyAggregation", "Run"]
