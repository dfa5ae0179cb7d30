"""Relational operators: index build, retrieval, reports, skew handling."""
