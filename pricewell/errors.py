"""Errors raised on the driver."""


class PricewellError(Exception):
    """Root of all."""


class ImportProblem(PricewellError):
    """An input can't be read."""


class FileMissing(ImportProblem):
    pass


class FileEmpty(ImportProblem):
    pass


class FileCorrupt(ImportProblem):
    pass


class EncodingUnreadable(ImportProblem):
    pass


class OrientationUnknown(ImportProblem):
    pass


class ColumnsMissing(ImportProblem):
    pass


class PeriodUnreadable(ImportProblem):
    pass


class SeriesEmpty(ImportProblem):
    pass


class DomainProblem(PricewellError):
    """Inputs or results break a rule of the domain."""


class InvariantBroken(DomainProblem):
    pass


class PeriodUnavailable(DomainProblem):
    pass


class CalculationProblem(PricewellError):
    """A computation has no valid result."""


class ValidationProblem(PricewellError):
    """The official source can't be compared with."""


class SourceUnavailable(ValidationProblem):
    pass


class ResponseInvalid(ValidationProblem):
    pass


class ConfigurationProblem(PricewellError):
    """Arguments or settings are invalid."""
