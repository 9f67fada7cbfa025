"""Change feeds by Structured Streaming."""
