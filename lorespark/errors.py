"""Errors of the library, each with the exit code that a command line would return."""

from __future__ import annotations


class LoreError(Exception):
    code = 1


class UsageError(LoreError):
    code = 2


class NotFound(LoreError):
    code = 3


class Ambiguous(LoreError):
    code = 4


class ConfigError(LoreError):
    code = 5


class IndexMissing(LoreError):
    code = 6


class UnclosedQuote(UsageError):
    pass


class NotSearchable(UsageError):
    """A filter that only graph queries support."""
