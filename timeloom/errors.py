"""Errors of argument checks on the driver; rows that break a strict rule raise inside Spark."""


class TimelineError(ValueError):
    """An argument outside the range that an operator accepts."""


class UnknownName(TimelineError):
    """A strategy, order or sink that does not exist."""


class AllBatchesFailed(RuntimeError):
    """No batch of a timeline could be analysed."""


class CostRefused(RuntimeError):
    """The estimate is over the cap and nobody confirmed it."""
