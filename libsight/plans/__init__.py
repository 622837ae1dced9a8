"""Named queries over the input tables, with SQL oracles where SQL can state them."""

from libsight.plans import (  # noqa: F401
    reading, library, retrieval, texts, ingest, layouts, streams, snapshots)
from libsight.plans.registry import ORACLES, QUERIES  # noqa: F401
