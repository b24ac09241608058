"""Fitted cleaning steps applied to streaming DataFrames."""
