"""Streams that take every arriving file once."""
