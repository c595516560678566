"""Errors of the library, and the exit codes that the command line gives them."""


class TidefoldError(Exception):
    exit_code = 3


class ParamError(TidefoldError, ValueError):
    """A parameter, model or option that can't be used."""

    exit_code = 2


class NumericalError(TidefoldError):
    """A computation that gave no usable number."""

    exit_code = 1


class CovarianceError(NumericalError):
    """A covariance that isn't one."""


class InvertibilityError(NumericalError):
    """A matrix that can't be inverted."""


class FilterError(TidefoldError):
    """A filter that can't run, or failed."""

    exit_code = 1
