"""Readers and writers: CSV scans, Parquet tables, forecast and metric stores."""
