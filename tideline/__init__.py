"""Tideline: security-log analytics as DataFrame, SQL and Structured Streaming jobs."""
