"""Exceptions of the library."""

from __future__ import annotations


class PrepError(Exception):
    """Base of all errors raised here."""


class ColumnNotFound(PrepError):
    def __init__(self, name: str, known: list[str] | None = None):
        super().__init__(f"column {name!r} not found" + (f"; columns are {', '.join(known)}" if known else ""))
        self.name = name


class InvalidConfig(PrepError, ValueError):
    pass


class UnsupportedFormat(PrepError, ValueError):
    pass


class EmptyDataset(PrepError):
    pass


class SchemaMismatch(PrepError):
    pass


class IndexOutOfBounds(PrepError, IndexError):
    pass


class StorageError(PrepError):
    pass


class ParseError(PrepError, ValueError):
    pass


class FormatError(PrepError, ValueError):
    pass


class ChecksumMismatch(FormatError):
    pass


class SignatureInvalid(FormatError):
    pass


class DecryptionFailed(FormatError):
    pass


class LicenseExpired(FormatError):
    pass


class NotFound(PrepError, KeyError):
    pass
