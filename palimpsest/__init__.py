"""Batch and streaming analytics over LLM conversations, on Spark DataFrames."""
