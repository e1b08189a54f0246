"""Readers and writers of the input and log formats."""
