"""Typed errors: each has a category, a stable code, and the builtin base that callers expect."""

from __future__ import annotations


class EngineError(RuntimeError):
    category, code = "internal", "internal"

    def __str__(self) -> str:
        return f"{self.code}: {' '.join(map(str, self.args))}"


class InvalidArgumentError(EngineError, ValueError):
    category, code = "invalid_argument", "invalid_argument"


class NotBatchBoundaryError(InvalidArgumentError):
    """A position inside a batch."""


class OffsetBeyondHeadError(InvalidArgumentError):
    code = "offset_beyond_head"


class PositionUnavailableError(InvalidArgumentError):
    """A position below the retention floor (or a feed start beyond the durable head)."""

    code = "position_unavailable"

    def __init__(self, *args: object, bootstrap: dict | None = None):
        super().__init__(*args)
        self.bootstrap = bootstrap


class ConflictError(EngineError, ValueError):
    category, code = "conflict", "conflict"


class RevisionConflictError(ConflictError):
    """The stream isn't at the expected revision."""


class EventIdConflictError(ConflictError):
    """An event id exists with other content, or known and new ids are mixed."""


class IdempotencyConflictError(ConflictError):
    """An idempotency key exists with other content."""


class BatchIdConflictError(ConflictError):
    """A batch id exists with other content."""


class BranchExistsError(ConflictError):
    """A branch of that name or id exists."""


class BranchArchivedError(ConflictError):
    code = "branch_archived"


class NotFoundError(EngineError, KeyError):
    category, code = "not_found", "not_found"


class BranchNotFoundError(NotFoundError):
    """No branch of that name or id."""


class RuntimeMissingError(NotFoundError):
    code = "runtime_missing"


class LockedError(EngineError, OSError):
    category, code = "locked", "locked"


class IoError(EngineError, OSError):
    category, code = "io", "io"


class CorruptionError(EngineError):
    category, code = "corruption", "corruption"


class ManifestError(CorruptionError):
    """A commit manifest that can't be read, or that contradicts others."""


class InvalidBranchAncestryError(CorruptionError):
    """Branches without a common root, in a circle, or too deep."""


class UnsupportedFormatError(EngineError):
    category, code = "unsupported_format", "unsupported_format"


class CodecError(EngineError, ValueError):
    category, code = "codec", "codec"


class ResourceLimitError(EngineError, ValueError):
    category, code = "resource_limit", "resource_limit"


class CancelledError(EngineError):
    category, code = "cancelled", "cancelled"


class ClosedError(CancelledError):
    code = "engine_closed"


class MigrationError(EngineError):
    code = "migration"


class MigrationIncompleteError(MigrationError):
    """An import that was broken off; run it again to resume it."""
