"""Readers and writers: raw text, bronze Parquet, reference tables, JDBC."""
