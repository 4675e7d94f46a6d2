"""Consent and tracker analytics as PySpark DataFrame operators."""
