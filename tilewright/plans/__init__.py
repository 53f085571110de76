"""Named queries. ``load`` imports every plan module and returns the registry."""

import importlib

MODULES = ["change_plans", "filter_plans", "scalar_plans", "raster_plans", "search_plans", "region_plans", "grid_plans", "source_plans", "validate_plans", "stream_plans"]


def load():
    registry = importlib.import_module(".registry", __name__)
    for module in MODULES:
        importlib.import_module("." + module, __name__)
    return registry
