"""The shared catalog instance and the modules that fill it."""

from swathline.catalog import Catalog

CATALOG = Catalog()
query = CATALOG.add

MODULES: list[str] = ["radiometry", "geodesy", "trajectory", "motion", "projection", "ortho", "shifts", "tiepoints", "files"]
