"""Whole computations: one tag, one model, publishing, models from metadata tables."""
