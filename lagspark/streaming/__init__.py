"""Streams of events to grid rows, and innovations filtering with state. An extension of the batch operators."""

from .filter import filter_stream, grid_stream  # noqa: F401
