"""Streaming ingestion of logs, the historical import, and the periodic flush of event counts."""
