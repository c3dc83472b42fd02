"""Streaming sessions: epochs as micro-batches, keyed state with snapshots."""
