"""Structured Streaming forms of the availability-time operators (an extension: the batch operators define the results)."""
