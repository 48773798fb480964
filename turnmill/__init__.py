"""Conversation-corpus analytics on Spark."""
