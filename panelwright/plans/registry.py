"""Named queries over the driver tables and the SQL each is checked against."""

from __future__ import annotations

from panelwright.sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "panel_features"


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under name."""

    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


@query("region_scan", "SELECT r_regionkey, r_name FROM region")
def region_scan(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", "r_name")


from panelwright.plans import aggregation, bundled, bundles, derived, evidence, identities, joining, labelled, landing, learning, linked, matrix, measures, panel, quality, retrieval, ruled, searching, serving, streams, tagging, textual, windowed  # noqa: E402, F401
