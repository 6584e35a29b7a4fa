"""The engine's queries over the input tables, a module for each part of the operator inventory. Importing this registers all."""

from importlib import import_module
from pkgutil import iter_modules

for _module in sorted(m.name for m in iter_modules(__path__)):
    import_module(f"{__name__}.{_module}")
