"""Streams of trades."""
