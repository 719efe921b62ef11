"""Readers of survey files and writers of results."""
