"""Colloquy: conversation analytics written for Spark's DataFrame, SQL and Structured Streaming APIs."""
