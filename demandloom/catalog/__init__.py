"""Every operator as a query on the order tables, each with its DuckDB counterpart.

``ENTRIES`` maps a query name to the Spark callable and the SQL text (None where
SQL cannot state the result).
"""

from __future__ import annotations

from demandloom.catalog import analysis, explore, features, forecast, hierarchy, metrics, panel, regression, tables, windows
from demandloom.catalog.base import Entry

ENTRIES: dict[str, Entry] = {}
for _module in (tables, panel, features, forecast, windows, hierarchy, metrics, regression, analysis, explore):
    for _name, _entry in _module.ENTRIES.items():
        if _name in ENTRIES:
            raise ValueError(f"two queries named {_name}")
        ENTRIES[_name] = _entry
