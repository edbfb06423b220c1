"""All queries of the library by name, each with its SQL where there is one."""

from __future__ import annotations

from orbweave.plans import axis_queries, canal_queries, cohort_queries, measures_queries, part_queries, region_queries, report_queries, scoring_queries, shape_queries, spatial_queries, stream_queries, summary_queries, table_queries, volume_queries

MODULES = (measures_queries, table_queries, spatial_queries, axis_queries, scoring_queries, volume_queries, shape_queries, stream_queries, cohort_queries, report_queries, summary_queries, region_queries, canal_queries, part_queries)


def _united(tables: list[dict]) -> dict:
    """One table of all; a name that comes twice is an error."""
    out: dict = {}
    for table in tables:
        if twice := out.keys() & table.keys():
            raise ValueError(f"registered twice: {', '.join(sorted(twice))}")
        out |= table
    return out


def queries() -> dict:
    return _united([module.QUERIES for module in MODULES])


def oracle_sql() -> dict[str, str]:
    return _united([module.ORACLE_SQL for module in MODULES])
