"""Every query of the library outside the corpus operators, with its oracle SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES (name -> callable) and ORACLE_SQL (name -> SQL).
MODULES: tuple[str, ...] = ("operators.windows", "operators.islands", "operators.joins", "operators.statistics", "operators.signal", "operators.trajectory", "operators.indices", "operators.spatial", "operators.enrichment", "operators.spectral", "operators.formats", "operators.quality", "operators.delay", "operators.disconnects", "operators.inference", "operators.surfaces", "operators.isobands", "operators.discs", "operators.places", "operators.junctions", "operators.junction_turns", "operators.map_pieces", "operators.revisits", "operators.responses", "operators.radio")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"dermotrace.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
