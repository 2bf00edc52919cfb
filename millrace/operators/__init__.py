"""Operators on DataFrames: joins, totals, profiles, checks, graphs."""
