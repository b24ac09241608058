"""Analyses built from several steps: profiles, suggestions, insights, reports."""
