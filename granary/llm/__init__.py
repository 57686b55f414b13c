"""Operators for preparing training data (ten dealt operators and their queries)."""
