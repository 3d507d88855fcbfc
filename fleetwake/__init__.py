"""Drifting-platform trajectory analytics as Spark DataFrame jobs."""
