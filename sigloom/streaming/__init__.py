"""Programs as Structured Streaming queries."""
