"""A PySpark engine that cleans document pages and analyses the results."""

from foliowash.config import Config, preset
from foliowash.plans.clean import clean, clean_page

__version__ = "0.1.0"
__all__ = ["Config", "clean", "clean_page", "preset", "__version__"]
