"""Refusals, by what a caller can do about them."""


class QueryError(Exception):
    """Base of everything that the engine refuses; ``status`` is what a wire adapter answers."""

    status = 500


class UnknownEntityError(QueryError):
    """The request names an entity that the model doesn't have."""

    status = 404


class InvalidQueryError(QueryError):
    """The request is malformed, ambiguous or unsafe."""

    status = 400


class ScopeError(QueryError):
    """A table that the request touches has no scope."""

    status = 400


class ModelError(QueryError):
    """The model itself is wrong; raised when it is loaded."""
