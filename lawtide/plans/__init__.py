"""Whole runs, reports and the registry of checked queries."""
