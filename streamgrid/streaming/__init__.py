"""Structured Streaming forms of the operators that need state or lateness handling."""
