"""The registered queries do the whole job: rules, lists and bounds as they are set up for production."""

import numpy as np
from pyspark.sql import functions as F

from tellura.llm import queries, toxicity, urls


def test_registered_rules(spark):
    """The five rules of the contract; an exception has the other verdict than its rule."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert [f"{r.verdict} {r.text}" for r in queries.RULES] == contract.split(", ")
    pages = spark.createDataFrame([(0, "http://a.net/de/1"), (1, "http://m.example.net/de/9"), (2, "http://m.example.net/de/81"), (3, "http://a.com/en/1"), (4, "http://example.com/en/70")], "page_id long, url string")
    got = urls.judge_urls(pages, queries.RULES, pages.limit(0).select("url")).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["allow", "allow", "block", "block", "allow"]


def test_listed_families(spark, tmp_path):
    """A URL of each planted family is blocked where no rule decides, and no other."""
    families = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
    hosts = [f"m.{f}.example.org" for f in families] + ["m.other-one.example.org"]
    spark.createDataFrame([(i, f"http://{h}/fr/{i}") for i, h in enumerate(hosts)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["verdict"] for r in queries.op7_url_filters(spark, str(tmp_path)).collect()}
    assert got == {**{i: "block" for i in range(6)}, 6: "allow"}
    planted = "|".join(f"{f}[.]" for f in families)
    left = queries.op7_url_filters(spark, "/root/testdata/sf0.01").where(F.col("rule").isNull() & F.col("host").rlike(planted))
    assert {r["verdict"] for r in left.collect()} == {"block"}


def test_repeated_and_spaced_letters(spark):
    """One repeated letter hides no insult, nor do spaces between the letters of a short or a long one."""
    rng = np.random.default_rng(4)
    bad = ["idiot", "stupid", "pathetic", "ass", "git", "goodfornothingloser"]
    plain = ["the", "water", "runs", "over", "green", "hills", "and", "people", "stand", "near", "old", "houses", "reading", "letters", "grass", "as"]
    texts = []
    for i in range(300):
        w = list(rng.choice(plain, 30))
        if i % 5 == 0:
            for b in rng.choice(bad, 3, replace=False):
                w.insert(int(rng.integers(0, len(w))), str(b))
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int"))
    hidden = [
        "the iddiot water sttupid runs", "idiiot and paathetic people", "an a s s near the g i t water", "the g o o d f o r n o t h i n g l o s e r stand",
        "the i d i o t and s t u p i d p a t h e t i c people", "the grass and letters over green hills", "people stand near o l d houses reading",
    ]
    got = [r["_score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(hidden)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert all(s >= 0.3 for s in got[:5]) and all(s < 0.3 for s in got[5:]), got
