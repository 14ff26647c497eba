"""Errors of the engine; all are ValueErrors."""


class NearfieldError(ValueError):
    """Any error that the engine raises on purpose."""


class InvalidVectors(NearfieldError):
    """Vectors, or a result, that break the contract."""


class InvalidParameter(NearfieldError):
    """A parameter of the wrong type or out of range."""


class StrategyUnavailable(NearfieldError):
    """A strategy that this installation can't run."""


class UnsupportedObjective(NearfieldError):
    """A strategy that doesn't serve the asked objective."""
