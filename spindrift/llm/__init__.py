"""Operators that prepare text and rankings for language models; nothing outside this package imports it."""
