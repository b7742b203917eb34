"""Timing and telemetry features as Spark DataFrame operators."""
