"""Reconciliation and change analytics on PySpark."""
