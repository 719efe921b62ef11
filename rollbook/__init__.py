"""Rollbook: panel-attendance analytics as plain PySpark DataFrame functions."""
