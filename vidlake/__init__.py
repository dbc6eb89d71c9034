"""Clean tables of videos and comments from captured pages and responses, on Spark."""

__version__ = "0.1.0"

#: Provenance tag stamped on every exported record.
SOURCE = f"vidlake/{__version__}"
