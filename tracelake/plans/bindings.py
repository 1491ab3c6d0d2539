"""The catalog tables themselves, as whole-table queries."""

from __future__ import annotations

from tracelake.plans.registry import query
from tracelake.sources.bindings import TABLES


def _register(name: str) -> None:
    @query(f"s12_catalog_{name}", f"select * from @{name}")
    def table(cat):
        return getattr(cat, name)


for _name in ("sessions", "related_runs", "artifacts", "edges", "assets", "collection_entries"):
    assert _name in TABLES
    _register(_name)


@query("s12_catalog_asset_snapshots", """
select archive, asset_id, ord, sha256, bytes, at_day, trigger, pending_gc from @asset_snapshots""")
def asset_snapshots(cat):
    return cat.asset_snapshots.select("archive", "asset_id", "ord", "sha256", "bytes", "at_day",
                                      "trigger", "pending_gc")
