"""The queries of the library on the smallest tables, against DuckDB where there is SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tellura.plans import catalog, catalog_files  # noqa: F401, the second registers its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name])
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        at = [want.columns.index(c) for c in names]
        rows = want.fetchall()
        assert len(rows) == len(got)
        key = lambda r: tuple(str(plain(v)) for v in r)
        assert sorted(key([r[i] for i in at]) for r in rows) == sorted(key([r[c] for c in names]) for r in got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest stands without them."""
    root = Path(__file__).parent.parent
    (tmp_path / "tellura").mkdir()
    for p in (root / "tellura").iterdir():
        if p.name != "llm":
            (tmp_path / "tellura" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'impedance' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], check=True, cwd=tmp_path)
