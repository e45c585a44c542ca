"""Queries by area; importing an area registers its queries."""

from importlib import import_module

AREAS = ["features", "signal", "scoring", "metrics", "positivity", "splits", "sampling", "annotations", "names", "quality", "patches", "tiling", "composition", "streaming", "learning", "files", "archives"]


def load_all() -> None:
    for area in AREAS:
        import_module(f"spatialframes.plans.{area}")
