"""Cloud billing, telemetry, policy and drift analytics as Spark DataFrame functions."""

__version__ = "0.1.0"
