"""What the engine raises; ``status`` is the HTTP status a service would answer with."""

from __future__ import annotations


class StrataError(Exception):
    status = 500
    public = True

    def body(self) -> dict:
        """The answer of a service; the text of internal errors stays inside."""
        return {"message": str(self) if self.public else "internal error"}


class InvalidRequest(StrataError):
    status = 400


class NotFound(StrataError):
    status = 404


class TooManyRequests(StrataError):
    status = 429


class Internal(StrataError):
    public = False


class Corrupt(StrataError):
    public = False


class CommitConflict(Internal):
    """Another writer took the log entry; the operation may be tried again."""
