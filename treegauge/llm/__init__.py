"""Operators for building training corpora. Nothing else in treegauge imports this package."""
