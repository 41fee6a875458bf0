"""Readers and writers: exported host logs, queued batches, event, receipt and export tables."""
