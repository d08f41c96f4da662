"""Named queries over the given tables, each with the portable SQL it must agree with where SQL can say it."""

from tenora.catalog.registry import CATALOG


def load() -> dict:
    from tenora.catalog import basics, reports, segments, tables  # noqa: F401
    return CATALOG
