"""Disc-image analytics as PySpark DataFrame and Column transformations."""
