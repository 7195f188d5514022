"""Operators for building training corpora: language, duplicates, leaks, mixing, toxicity, language models."""
