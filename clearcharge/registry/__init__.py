"""Every operator as a named query over the driver's tables, with the SQL it is checked by."""

from __future__ import annotations


def all_queries():
    """(queries, oracle SQL) by name."""
    from clearcharge.registry import core, reg_aggregates, reg_catalog, reg_charges, reg_files, reg_freshness, reg_names, reg_places, reg_store, reg_streams, reg_text  # noqa: F401

    return core.QUERIES, core.ORACLES
