"""Errors and warnings of the table API."""


class SearchIndexInconsistentError(Exception):
    """The table changed after its search index was built."""


class NoSuchIndexError(KeyError):
    """There is no search index to rebuild."""


class UnableToExtractAttributeNamesError(ValueError):
    """A row's field names can't be told."""


class ReadonlyIndexAccessError(Exception):
    """An index view can't be written."""


class PathNotFoundError(KeyError):
    """The JSON document has no such path."""


class AuthenticationWarning(Warning):
    """Credentials are about to travel unencrypted."""
