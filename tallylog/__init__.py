"""Service logs and metered-usage receipts as Spark DataFrame jobs."""
