"""Structured Streaming operators with their batch twins elsewhere in the package."""
