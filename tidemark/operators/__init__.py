"""Operators on DataFrames of change records, versions, tokens, rumours, metrics and histories."""
