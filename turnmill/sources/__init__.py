"""Readers and writers of the formats that corpora come in."""
