"""Reusable plan shapes: ordered scans without a global sort, and the derived input tables."""
