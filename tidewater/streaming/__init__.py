"""Streams: none; every source and operator here is bounded."""
