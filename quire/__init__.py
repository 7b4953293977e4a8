"""quire: a PySpark-native engine for building and querying catalogs of
publications and documents (ingest, curate, enrich, validate, analyse)."""

__version__ = "0.1.0"
