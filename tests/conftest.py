from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    session = local_session(4, 4)
    yield session

    from tessera.sources import scratch

    scratch.clear(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return own


def plain(value):
    """A value in a form that compares between engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sample_registry(spark):
    """A small registry of customers."""
    rows = [
        ("acme", "Acme Corp", "dev", ["wms"], "", ["ACME Inc", "acme!"], {"dev": {"k8s_namespace": "d"}, "prod": {"k8s_namespace": "p"}}, 0),
        ("globex", "Globex", "solution", ["rdc", "teleport"], "", None, {}, 1),
        ("initech", "Initech", "solution", [], "", [], {}, 2),
    ]
    return spark.createDataFrame(rows, "id string, name string, lifecycle_stage string, products array<string>, notes string, aliases array<string>, environments map<string,map<string,string>>, position int")
