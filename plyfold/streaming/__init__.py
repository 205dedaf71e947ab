"""Documents in and out of Structured Streaming."""
