"""Listing alerts as Spark jobs: pages in, ranked and de-duplicated alerts out."""

from alertloom.config import Rules, Settings

__all__ = ["Rules", "Settings"]
