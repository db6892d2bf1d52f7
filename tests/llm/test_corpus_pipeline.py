"""The pipeline on the smallest tables, stage by stage, and the SQL of the queries."""

from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tellura.llm import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        rows = out.collect()
        kept[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "source_mixing", "packing"]
    n = 200
    assert 0.7 * n < len(kept["toxicity"]) < n
    sets = []
    for r in kept["ngram_join"]:  # no pair of five-word shingle sets is left at 0.8 or more
        w = r["text"].lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    assert not any(a and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    windows = Counter(tuple(w[i : i + 50]) for w in (r["text"].split() for r in kept["ngram_join"]) for i in range(len(w) - 49))
    for r in kept["substring_dedup"]:
        w = r["text"].split()
        assert not any(windows[tuple(w[i : i + 50])] > 1 for i in range(len(w) - 49))
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in final}) == len(final)
    assert Counter(r["doc_id"] for r in final if r["piece"] == 0) == Counter(r["doc_id"] for r in kept["source_mixing"])


ODD_NAMES = ("_text", "_score", "_key", "_cut", "_table", "_name", "_u", "_n", "_copy", "_rate", "_shuffle_key", "row", "id", "key", "hash", "text_hash", "sid", "left", "component_id", "spread", "words", "a.b")


def odd_docs(spark):
    """Null, empty, blank, short and long texts, copies, null and repeated ids, a repeated row, null sources, and columns that stages might use themselves."""
    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, n))
    base, other, passage = words(120), words(130), words(60)
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, words(9000)), (6, base), (7, base), (8, base + " tail"), (9, words(40) + " " + passage), (10, passage + " " + words(40)), (None, other), (None, words(70)), (11, other), (12, base), (12, words(80)), (13, words(50))]
    rows = [(i, t, "en", None if k % 5 == 0 else f"src{k % 2}", len(t or "")) for k, (i, t) in enumerate([*texts, texts[-1]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs.select("*", *[F.lit(7).alias(c) for c in ODD_NAMES])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    docs, stage = odd_docs(spark), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
        return
    assert out.columns == docs.columns and all(r[c] == 7 for r in rows for c in ODD_NAMES)
    kept = Counter((r["doc_id"], r["text"]) for r in rows)
    every = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    by_id = {i: t for i, t in every}
    if name == "toxicity":
        assert kept == every
    if name == "ngram_join":
        base = by_id[6]
        want = Counter(set(every))
        for gone in ((7, base), (8, by_id[8]), (12, base), (None, by_id[11])):  # copies of 6, and the null id's copy of 11
            del want[gone]
        assert kept == want
    if name == "substring_dedup":
        assert {i for i, _ in kept} >= {0, 1, 2, 3, 4, 5, 9, 10, 12, None} and not {6, 7, 13} & {i for i, _ in kept}
        assert {t for i, t in kept if i == 8} == {"tail"} and kept[0, None] == kept[1, ""] == 1
        assert all(len(t.split()) == 40 for i, t in kept if i in (9, 10))
    if name == "source_mixing":
        assert set(kept) <= set(every)


def test_one_of_each_group(spark):
    """Ids that repeat: a text that goes takes no other text of its id with it, and none stays beside its head."""
    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text), (5, text), (5, other)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"][0]) for r in got) == [(3, "a"), (5, "b")]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert sorted(map(str, ([r[i] for i in at] for r in want.fetchall()))) == sorted(str([r[c] for c in names]) for r in got.collect())
