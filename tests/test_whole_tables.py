"""Queries of the catalogue give whole tables: no subset of ids, components or channels."""

import duckdb
import pytest

from tellura.plans import catalog

SF = "/root/testdata/sf0.001"


def test_names_of_all_orders(spark):
    want = {(v, f"{v:.6f}".replace(".", "_")) for (v,) in duckdb.sql(f"SELECT o_totalprice::DOUBLE FROM '{SF}/orders.parquet'").fetchall()}
    got = [(float(r["fs"]), r["name"]) for r in catalog.QUERIES["fs_names"](spark, SF).collect()]
    assert len(got) == len(want) > 1000 and set(got) == want


def test_text_of_whole_vectors(spark):
    want = {i: ", ".join(f"{x:.4f}" for x in v) for i, v in duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()}
    assert {r["vec_id"]: r["text"] for r in catalog.QUERIES["array_text"](spark, SF).collect()} == want


@pytest.mark.parametrize(
    ("name", "cut", "whole", "column", "channels"),
    [
        ("fft_spectra", " FROM z WHERE chan = 'Ex'", " FROM z", "chan", "Ex Ey Hx Hy Hz"),
        ("fft_evals_kernel", " FROM evals WHERE chan = 'Hy'", " FROM evals", "chan", "Ex Ey Hx Hy Hz"),
        ("agg_remove_mean", " FROM s WHERE chan = 'Hz'", " FROM s WHERE value IS NOT NULL", "chan", "Ex Ey Hx Hy Hz"),
        ("apply_function", " FROM clean WHERE chan IN ('Ex', 'Hy')", " FROM clean", "chan", "Ex Ey Hx Hy Hz"),
        ("regression_rows", "o.chan = 'Ex' AND", "o.chan IN ('Ex', 'Ey') AND", "out_chan", "Ex Ey"),
    ],
)
def test_all_channels(spark, name, cut, whole, column, channels):
    """Against the query's SQL as it would be for all channels, whether the registered SQL is or not."""
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalog.ORACLES[name].replace(cut, whole))
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert sorted({r[column] for r in rows}) == channels.split()
    plain = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    assert sorted(str([plain(v) for v in r]) for r in want.fetchall()) == sorted(str([plain(r[c]) for c in want.columns]) for r in rows)
