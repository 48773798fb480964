"""Registered queries, and the jobs that chain operators from raw data to training samples."""
