"""The batch expressions kept current by Structured Streaming."""
