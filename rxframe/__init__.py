"""Prescription analytics as Spark DataFrame operators."""
