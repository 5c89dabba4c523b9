"""Every registered query by name, with its SQL for a second engine.

The programs are parameterised by columns; here they run on the driver's tables, which stand in for the catalogue: events
for element sets (user = object, value = a length), orders for statuses and filings, lineitem with part and supplier for
products and makers, customer and supplier for entities. Doubles are rounded to nine places in both engines.
"""

from __future__ import annotations

from . import landing, programs, standins, upkeep  # noqa: F401  landing, programs and upkeep register their queries with standins

_ALL = standins.collect()


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
