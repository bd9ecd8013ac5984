"""The catalogue of queries over the driver tables, with the SQL that checks each."""

from . import catalogue, leads, results, rounds  # noqa: F401  (all register their queries)
