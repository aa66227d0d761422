"""Operators on DataFrames: items, values, post-processing, formulas, results, lookups, pages, categories."""
