"""Sievelake: analytics over collections of semi-structured rows, on Spark."""
