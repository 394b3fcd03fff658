"""Named queries over the star-schema tables, and their SQL counterparts."""

from importlib import import_module

MODULE_NAMES = (
    "summary_queries",
    "prepare_queries",
    "lookup_queries",
    "quality_queries",
    "compare_queries",
    "external_queries",
)


def modules() -> list:
    return [import_module(f"workload.{name}") for name in MODULE_NAMES]
