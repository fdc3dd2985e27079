"""Errors that index operations raise on the driver, before a job runs."""

from __future__ import annotations


class VectorIndexError(Exception):
    """Base of all errors of this package."""


class DimensionMismatch(VectorIndexError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected dimension {expected}, got {got}")
        self.expected, self.got = expected, got


class EmptyIndex(VectorIndexError):
    """A search on, or a build from, no vectors."""


class InvalidHeader(VectorIndexError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"{path}: {reason}")
        self.path, self.reason = path, reason


class FileSizeMismatch(VectorIndexError):
    def __init__(self, path: str, expected: int, got: int):
        super().__init__(f"{path}: expected {expected} bytes, got {got}")
        self.path, self.expected, self.got = path, expected, got


class InvalidConfig(VectorIndexError):
    """A parameter outside its range."""


class InvalidArgument(VectorIndexError):
    """A search request that no shard can answer: empty query, k = 0, other dimension or metric."""


class Unavailable(VectorIndexError):
    """No shard answered a search."""
