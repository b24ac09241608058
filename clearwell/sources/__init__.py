"""Reading raw files and writing cleaned tables and reports."""
