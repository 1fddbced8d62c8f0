"""Relational operators of the dashboard, the rollup and the stored tables."""
