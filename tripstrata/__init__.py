"""tripstrata: a layered trip warehouse expressed as Spark DataFrame jobs.

Layers, each a Parquet table under one root folder::

    raw  ->  stg (never stored)  ->  clean + quarantine  ->  three marts

See README.md for the map from operators to modules.
"""
