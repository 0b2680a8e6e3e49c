"""Errors raised by the engine."""


class ModeCountError(ValueError):
    """The number of modes is not positive or beyond the supported maximum."""


class StaleFunctionalError(RuntimeError):
    """A functional was called after the propagator it was built from had changed."""


class ToleranceOrderError(ValueError, RuntimeError):
    """upper_atol would lie below lower_atol."""
