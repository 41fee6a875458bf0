"""Reusable distributed operators: ordered scans, first-wins, skew-safe look-ups, queries."""
