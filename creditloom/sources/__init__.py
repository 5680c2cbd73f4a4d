"""Readers and writers for loan text files, macro series, score tables and report tables."""
