"""Auditable text extraction, adjudication and corpus quality on Spark DataFrames."""
