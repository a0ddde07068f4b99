"""The reads of feed analytics for one tenant: the same queries on its feeds and their items alone.

The scope is set where a query reads its views, so no read can leave it out, and it reaches the scans: feeds by a filter, items
by a semi-join on their feed before anything is joined or aggregated.
"""

from __future__ import annotations

import functools

from reelgrid.plans import catalog, presentation, serving
from reelgrid.sources.tables import scope, scoped_sql

QUERIES, ORACLES = {}, {}
#: The tenant that the registered forms are for.
TENANT = 1
READS = {
    serving: ["trending", "best_metadata", "items_search", "items_status", "items_keyset", "media_detail", "feeds_with_counts", "backlog_anti", "rating_backfill", "rematch_candidates"],
    catalog: ["item_shelves", "provider_choices", "automatic_match"],
    presentation: ["presented_titles"],
}


def of_tenant(query, tenant: int):
    @functools.wraps(query)
    def run(spark, d):
        with scope(tenant):
            return query(spark, d)

    return run


for module, names in READS.items():
    for name in names:
        QUERIES[f"tenant_{name}"] = of_tenant(module.QUERIES[name], TENANT)
        ORACLES[f"tenant_{name}"] = scoped_sql(module.ORACLES[name], TENANT)
