"""Versioned-document, inventory and telemetry analytics on PySpark."""
