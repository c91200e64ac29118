"""All queries of the library by name, and the SQL that the checkable ones must agree with."""

from __future__ import annotations

from agoraspark.functions import names, search, text  # noqa: F401
from agoraspark.operators import aggregates, containment, filters, joins, ordering, selection, sets, windows  # noqa: F401
from agoraspark.plans import attention, cascade, genders, incremental, linkage, merging, quality, statistics  # noqa: F401
from agoraspark.registry import ORACLES, QUERIES
from agoraspark.sources import html, pages, tables  # noqa: F401
from agoraspark.streaming import classification, events  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
