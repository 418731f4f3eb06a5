"""One exception class for each kind of refusal."""


class LaminaError(Exception):
    """Base of all errors of this package."""


class InvalidOp(LaminaError):
    """An operation's envelope is malformed; the whole batch is refused."""


class IdentityCollision(LaminaError):
    """Two different payloads claim one (document, site, seq)."""


class InvalidCommand(LaminaError):
    """A local command does not fit the current state."""


class InvalidSyncState(LaminaError):
    """Delta metadata or an acknowledgement is inconsistent."""


class UnknownFeature(LaminaError):
    """The feature does not exist or is not visible."""


class DocumentMismatch(LaminaError):
    """Operations of another document."""


class BaseMismatch(LaminaError):
    """Documents of different base lineage."""


class UnsupportedVersion(LaminaError):
    """A wire format of another version."""


class InvalidSnapshot(LaminaError):
    """A snapshot violates a structural rule."""


class CompactionGap(LaminaError):
    """The sender folded away operations that the receiver never saw."""


class RebaseUnsafe(LaminaError):
    """The log still holds something that an epoch cut would lose."""


class UnsupportedGeometry(LaminaError):
    """A geometry type that the engine does not model."""


class InvalidGeometry(LaminaError):
    """A geometry that is malformed."""


class InvalidTopology(LaminaError):
    """A polygon that is not valid."""
