"""Spark jobs that prepare long-form text for narration and report on the work around it."""
