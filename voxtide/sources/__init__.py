"""Readers and writers of the files that runs exchange."""
