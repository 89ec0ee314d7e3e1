"""Independent SQL for checking the operators: plain joins and windows over the parquet tables."""
