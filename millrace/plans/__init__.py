"""The metric layer: definitions, the views of a metric as DataFrames, drill-down, and what shapes a result."""
