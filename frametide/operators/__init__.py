"""Operators on event streams, traces, engagements and records: DataFrame in, DataFrame out."""
