"""Registered queries over the driver tables; importing the package registers all of them."""

from . import catalog, surface, training, worlds  # noqa: F401
