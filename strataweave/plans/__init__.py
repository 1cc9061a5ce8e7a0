"""Merge plans: rules, conflicts, choices, reports."""
