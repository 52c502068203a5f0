"""Structured Streaming: sinks, stateful operators, windows."""
