"""DataFrame operators: enrichment, weighting, aggregation, lookups, quality, comparison."""
