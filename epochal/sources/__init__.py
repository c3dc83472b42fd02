"""Readers and writers of request logs, run files, write-ahead logs and snapshots."""
