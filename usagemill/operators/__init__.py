"""Operators from frame to frame."""
