"""Every operator as a query over the supplied tables."""

from rosterline.catalog import (  # noqa: F401
    cleaning, landing, merging, resolving, scoring, selection, storing, summaries, viewing,
)
from rosterline.catalog.registry import PYTHON, QUERIES, SQL  # noqa: F401
