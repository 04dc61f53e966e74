"""All registered queries of the library and their SQL."""

from __future__ import annotations

from crateflow.plans import datasets, library, matching, messages, metrics, scalars, series, signals, streams, text  # noqa: F401
from crateflow.plans.core import ORACLES, QUERIES  # noqa: F401
