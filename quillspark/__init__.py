"""A PySpark engine for searching rule corpora, looking up catalogs and placing parcels."""
