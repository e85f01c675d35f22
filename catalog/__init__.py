"""Every operator as a query over the given tables, with the SQL it must agree with."""

from importlib import import_module

PARTS = ["preparation", "simulation", "evaluation", "allocation", "modelling", "streams", "files", "raw_files"]


def load():
    from catalog.registry import ORACLES, QUERIES

    for part in PARTS:
        import_module(f"catalog.{part}")
    return QUERIES, ORACLES
