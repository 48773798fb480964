"""Operators over posts, threads, dialogues, tokens, vocabularies, topics, batches and evaluations: DataFrames in, DataFrames out."""
