"""Errors and warnings."""


class ReadError(Exception):
    """Bytes that are not what they should be."""


class CodecUnavailable(RuntimeError):
    """A format that needs a library that isn't here."""


class SkippedItemsWarning(UserWarning):
    """Items were left out of an append."""
