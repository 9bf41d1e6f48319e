"""Readers and writers of solver files, as DataFrames."""
