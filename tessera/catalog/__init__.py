"""Every registered query of the engine's own operators, and the DuckDB SQL that each is checked against."""

from tessera.catalog import records, retrieval, streams, texts  # noqa: F401  importing registers
from tessera.catalog.base import ORACLES, QUERIES  # noqa: F401
