"""Operators bound to the driver's tables, each beside its SQL check."""

from lexweave.plans.registry import REGISTRY, Inputs, with_views


def load() -> dict:
    """Import every plan module, so that the registry is full."""
    import importlib
    import pkgutil

    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    return REGISTRY


__all__ = ["REGISTRY", "Inputs", "load", "with_views"]
