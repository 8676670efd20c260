"""tidewire - news-curation operators for very large article feeds, on PySpark."""

__version__ = "0.1.0"
