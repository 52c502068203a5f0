"""The durable store: commits, segments, scans, and the streaming source."""
