"""Operators of a training-data pipeline (token counts, near-duplicates, licences, language, quality, mixing, HTML)."""
