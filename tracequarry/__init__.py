"""Trace and corpus analytics on PySpark: composable DataFrame operators."""
