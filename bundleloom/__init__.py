"""Pack analytics and optimisation on Spark."""

import importlib

#: Names of the public interface and where they live; loaded when first used, so that tasks import little.
_HOMES = {
    "Options": "options", "Optimizer": "operators.registry", "extensions": "operators.registry", "lookup": "operators.registry",
    "register": "operators.registry", "optimize": "operators.optimize", "PackEngine": "plans.engine", "PackError": "plans.engine",
}
__all__ = sorted(_HOMES)


def __getattr__(name):
    if name in _HOMES:
        return getattr(importlib.import_module(f"bundleloom.{_HOMES[name]}"), name)
    raise AttributeError(name)
