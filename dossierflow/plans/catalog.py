"""All registered queries over the given tables, with the SQL each is checked against."""

from __future__ import annotations

from dossierflow.plans import card_queries, entity_queries, inventory_queries, nested_queries, review_queries, source_queries, text_queries  # noqa: F401
from dossierflow.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "A5_category_counts"
