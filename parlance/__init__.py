"""Conversation analytics on Spark: transcripts, turns, names, voices and scores as DataFrame operators."""
