"""Spark jobs that train, score and report compact winner-take-all detectors."""
