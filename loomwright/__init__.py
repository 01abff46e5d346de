"""Page, site and search analytics as DataFrame operators."""

__version__ = "0.1.0"
