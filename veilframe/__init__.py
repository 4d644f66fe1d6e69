"""Pseudonymising, linking and redacting mixed clinical-study collections, as Spark DataFrame operators."""
