"""Spark ML preparation, training, validation, explanation and triage."""
