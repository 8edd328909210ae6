"""Sievewell: posting analytics and training-data operators on PySpark."""
