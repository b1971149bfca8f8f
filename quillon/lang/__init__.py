"""The query language: URL options and XML in, syntax trees out, and back."""
