"""Moderation operators on DataFrames: decisions, gates, limits, reports, word-list administration."""
