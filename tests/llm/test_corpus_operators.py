"""The ten operators against brute force, and on rows that are odd: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tellura.llm import embeddings, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, urls
from tellura.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def make(spark, texts, source=lambda i: f"src{i % 3}"):
    rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(rng, n, vocabulary=400):
    return [f"w{int(x)}" for x in rng.integers(0, vocabulary, n)]


def odd_texts():
    rng = np.random.default_rng(5)
    long = " ".join(words(rng, 6000, 3000))
    base = " ".join(words(rng, 120))
    return [None, "", "   \n\t ", "one", "one two", "One TWO", long, base, base, base + " tail", None, "é ß İ 中 \x0b x", base.upper()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, a repeated row, and columns whose names operators use themselves."""
    docs = make(spark, odd_texts())
    docs = docs.unionByName(docs.where("doc_id = 8"))
    for name in ("sid", "gid", "shard", "slot", "_text", "_id", "text_hash", "score", "_score", "kept", "n_words", "size", "_copy", "count", "uid", "cell", "_key"):
        docs = docs.withColumn(name, F.lit(1))
    return docs


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def heads(pairs, ids):
    """Least id of each component."""
    head = {i: i for i in ids}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


# --- sharding --------------------------------------------------------------


def test_shards(spark, odd):
    docs = make(spark, ["x" * (i % 50) for i in range(3000)])
    got = rows_of(sharding.assign_shards(docs, 40, bins=8))
    assert len(got) == 3000 and {r["shard"] for r in got} <= set(range(40))
    for shard in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    moved = sum(r["grown_shard"] == 40 for r in got)
    assert 3000 / 41 * 0.5 < moved < 3000 / 41 * 1.6
    assert all(r["size"] == r["doc_id"] % 50 + 16 and r["text_crc32"] == zlib.crc32(b"x" * (r["doc_id"] % 50)) for r in got)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) < 130
    again = rows_of(sharding.assign_shards(odd, 40))
    assert len(again) == odd.count() and {r["size"] for r in again if r["doc_id"] in (0, 1, 10)} == {16}
    assert len({(r["shard"], r["slot"]) for r in again}) == len(again)
    assert sharding.assign_shards(docs.limit(0), 40).count() == 0


def test_tree_confines_movement(spark):
    """A shard that gains weight: a region's gain is drawn from others, and within each subtree that gains, rows move only into the part that gained."""
    def tree(first):
        leaf = lambda s: sharding.Node(f"r{s // 4}/k{s // 2}/s{s}", shard=s, own_weight=first if s == 0 else 1.0)
        return sharding.Node("", tuple(sharding.Node(f"r{r}", tuple(sharding.Node(f"r{r}/k{k}", (leaf(2 * k), leaf(2 * k + 1))) for k in (2 * r, 2 * r + 1))) for r in (0, 1)))

    rows = spark.range(4000).select(sharding.place(F.col("id"), tree(1.0)).alias("a"), sharding.place(F.col("id"), tree(3.0)).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b // 4 == 0 for _, b in moved)
    assert all(b // 2 == 0 for a, b in moved if a // 4 == 0) and all(b == 0 for a, b in moved if a // 2 == 0)
    share = Counter(r["b"] for r in rows)
    assert share[0] / 4000 == pytest.approx(0.3, abs=0.04) and share[7] / 4000 == pytest.approx(0.1, abs=0.03)
    small = sharding.layout(3, (1, 1, 3))
    assert [c.shard for c in small.children[0].children[0].children] == [0, 1, 2]
    grown = sharding.layout(41)
    assert grown.children[-1].weight == 1 and grown.children[0].weight == 10
    for n in (0, 12, 39):  # a part of the fleet would not grow by the law
        with pytest.raises(ValueError):
            sharding.layout(n)


@pytest.mark.parametrize(("n", "fleet"), [(1, (1, 1, 1)), (4, (2, 1, 2)), (7, (2, 1, 2)), (12, (2, 2, 3)), (40, (4, 2, 5)), (43, (4, 2, 5))])
def test_one_more_shard_takes_rows_only_into_itself(spark, n, fleet):
    rows = spark.range(1500).select(sharding.place(F.col("id"), sharding.layout(n, fleet)).alias("a"), sharding.place(F.col("id"), sharding.layout(n + 1, fleet)).alias("b")).collect()
    moved = [r["b"] for r in rows if r["a"] != r["b"]]
    assert set(moved) == {n} and {r["a"] for r in rows} == set(range(n))


# --- n-gram join -----------------------------------------------------------


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


@pytest.mark.parametrize(("like", "cost"), [(ngram_join.Likeness(3, 90, 100), None), (ngram_join.Likeness(5, 80, 100), None), (ngram_join.Likeness(2, 70, 100), 50.0), (ngram_join.Likeness(1, 60, 100), 500.0)])
def test_ngram_join(spark, monkeypatch, like, cost):
    if cost is not None:  # dear verifications make the allocation choose one-deletion neighbourhoods
        allocate = ngram_join.allocate
        monkeypatch.setattr(ngram_join, "allocate", lambda *a: allocate(*a, verify=cost))
    rng = np.random.default_rng(11)
    texts = odd_texts()[:-1]
    for size in (4, 7, 12, 20, 35, 60, 130):
        base = words(rng, size)
        for k in range(12):
            copy = list(base)
            for at in rng.integers(0, size, rng.integers(0, 1 + size // 8)):
                copy[at] = f"x{int(rng.integers(0, 1000))}"
            texts.append(" ".join(copy[: size - int(rng.integers(0, 1 + size // 12))]))
    docs = make(spark, texts)
    sets = brute_sets(texts, like.words)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and like.den * len(sets[i] & sets[j]) >= like.num * len(sets[i] | sets[j])]
    want = heads(pairs, range(len(sets)))
    got = rows_of(ngram_join.join_documents(docs, like))
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in enumerate(sets)}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_allocations_cover():
    """Whatever is allocated: units of tolerance exceed the difference by what is spared."""
    for like in (ngram_join.Likeness(3, 90, 100), ngram_join.Likeness(5, 80, 100), ngram_join.Likeness(5, 50, 100)):
        edges = ngram_join.band_edges(5000, like)
        seen = set()
        for cost in (0.0, 2.0, 100.0, 10_000.0):
            for a, b in zip(edges, edges[1:]):
                band = ngram_join.allocate(a, b, 1000, like, cost)
                if band:
                    seen.add(band.loose > 0)
                    assert band.segments + band.loose == like.differ(b - 1, like.largest(b - 1)) + 1 + band.spare
        assert seen == {False, True}
        assert all(like.largest(b - 1) < edges[i + 2] for i, b in enumerate(edges[1:-1]))


def test_ngram_join_odd(spark, odd):
    got = rows_of(ngram_join.join_documents(odd))
    assert len(got) == odd.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (0, 1, 2, 7, 8, 12)} == {0: 0, 1: 1, 2: 2, 7: 7, 8: 7, 12: 7}
    assert ngram_join.join_documents(odd.limit(0)).count() == 0


def test_large_star_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROWS", 7)
    rng = np.random.default_rng(3)
    base, texts = words(rng, 80), []
    for _ in range(40):
        copy = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 4))):
            copy[at] = f"y{int(rng.integers(0, 10**6))}"
        texts.append(" ".join(copy))
    like = ngram_join.Likeness(3, 80, 100)
    sets = brute_sets(texts, 3)
    pairs = [(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert {r["doc_id"]: r["component_id"] for r in rows_of(ngram_join.join_documents(make(spark, texts), like))} == heads(pairs, range(40))


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(60)] + [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 80, (60, 2))]
    want = heads(pairs, {x for p in pairs for x in p})
    got = {r["node"]: r["component"] for r in rows_of(connected_components(spark.createDataFrame(pairs, "a long, b long")))}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)


# --- quality rules ---------------------------------------------------------


def test_quality_rules(spark, odd):
    rng = np.random.default_rng(7)
    texts = odd_texts()
    for i in range(60):
        own = [" ".join(words(rng, 12, 5000)) for _ in range(3)]
        texts.append("\n".join((["Accept  all\tcookies"] if i % 2 else []) + own + (own[:1] if i % 5 == 0 else [])))
    texts += [" ".join(f"copied{k}" for k in range(14))] * 20  # six or seven documents of each host: copies count
    texts += ["a b c d e f a b c d e f a b c d e", "x #* y\nx #* y\n\n \nz", "accept all COOKIES\naccept all cookies now"]
    limits = quality_rules.LineLimits(min_docs=4, share=0.01)
    got = {r["doc_id"]: r for r in rows_of(quality_rules.judge_documents(make(spark, texts), limits))}
    key = lambda x: b" ".join(x.lower().split())
    docs_of, held = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        if t:
            for line in t.encode().split(b"\n"):
                if line.split():
                    docs_of[f"src{i % 3}", key(line)].add(i)
                    held[f"src{i % 3}"].add(i)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        w = b.split()
        wins = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + o for k in range(len(w) - 4) if wins[tuple(w[k : k + 5])] > 1 for o in range(5)}
        lines = [x for x in b.split(b"\n") if x.split()]
        gone = sum(len(x.split()) for x in lines if len(docs_of[f"src{i % 3}", key(x)]) > max(4, 0.01 * len(held[f"src{i % 3}"])))
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(len(x.decode()) for x in w), sum(b.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == failed and r["n_removed_words"] == gone and r["kept"] == (not failed and 100 * (len(w) - gone) >= 30 * len(w))
    assert sum(r["n_removed_words"] > 0 for r in got.values()) > 20
    cut = {r["doc_id"]: r["text"] for r in rows_of(quality_rules.cut_lines(make(spark, texts), limits))}
    assert "cookies" not in cut[14].lower() and cut[0] is None and len(cut) == len(texts)
    assert len(rows_of(quality_rules.judge_documents(odd))) == odd.count()
    assert quality_rules.judge_documents(odd.limit(0)).count() == 0


# --- substring dedup -------------------------------------------------------


def brute_repeats(texts, size):
    w = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(x[i : i + size]) for x in w for i in range(len(x) - size + 1))
    out = []
    for x in w:
        gone = {i + o for i in range(len(x) - size + 1) if seen[tuple(x[i : i + size])] > 1 for o in range(size)}
        kept = [v for i, v in enumerate(x) if i not in gone]
        out.append((len(x), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("size", [2, 5, 11, 35])
def test_substring_dedup(spark, size):
    rng = np.random.default_rng(size)
    passage = words(rng, size * 2)
    texts = odd_texts()
    for i in range(40):
        x = words(rng, int(rng.integers(0, 90)), 50 if i % 4 == 0 else 3000)
        if i % 3 == 0:
            at = int(rng.integers(0, len(x) + 1))
            cut = int(rng.integers(0, size))
            x = x[:at] + passage[cut : cut + size + int(rng.integers(-1, 3))] + x[at:]
        texts.append("  ".join(x))
    texts += ["la " * 200, "la " * (size - 1), "la " * size]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substring_dedup.removed_words(make(spark, texts), size))}
    assert got == dict(enumerate(brute_repeats(texts, size)))


def test_substring_dedup_odd(spark, odd):
    got = rows_of(substring_dedup.removed_words(odd, 35))
    assert len(got) == odd.count() and all(r["n_removed"] == r["n_words"] for r in got if r["doc_id"] in (7, 8))
    assert substring_dedup.removed_words(odd.limit(0), 35).count() == 0
    docs = make(spark, ["a b c d e", "x a b c y", "q r s"])
    left = {r["doc_id"]: r["text"] for r in rows_of(substring_dedup.remove_repeats(docs, 3))}
    assert left == {0: "d e", 1: "x y", 2: "q r s"}
    both = make(spark, ["a b c d", "a b c d"])
    assert substring_dedup.remove_repeats(both, 3).count() == 0


def test_index_is_incremental(spark):
    """Batches one by one, with compaction on the way, point to what all at once would."""
    rng = np.random.default_rng(1)
    shared = [words(rng, 12) for _ in range(4)]
    texts = [" ".join(words(rng, 20, 9000) + shared[i % 4] + words(rng, 20, 9000)) for i in range(12)]
    docs = make(spark, texts)
    whole = substring_dedup.FingerprintIndex(spark).add(substring_dedup.fingerprints(docs, 8))
    index, found = substring_dedup.FingerprintIndex(spark, fan_in=2), set()
    for b in range(6):
        found |= {r["print"] for r in rows_of(index.add(substring_dedup.fingerprints(docs.where(f"doc_id % 6 = {b}"), 8)))}
    assert len(index.runs) <= 2 and found == {r["print"] for r in rows_of(whole)} and found
    assert index.compactions > 0
    (a, path), (b, _) = index.runs
    plan = index.joined(b, a)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # runs are joined bucket by bucket
    run = spark.table(a)
    assert run.count() == run.select("print").distinct().count()
    for file in {r[0] for r in run.select(F.input_file_name()).distinct().collect()}:
        prints = [r["print"] for r in spark.read.parquet(file).collect()]
        assert prints == sorted(prints)
    index.compact()
    assert len(index.runs) == 1
    index.drop()
    assert index.runs == []


def test_query_compacts_its_index(spark, monkeypatch):
    """A table is added in batches of which the third is compacted with those before it."""
    seen = []
    compact = substring_dedup.FingerprintIndex.compact
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "compact", lambda self: (seen.append(len(self.runs)), compact(self)))
    rng = np.random.default_rng(2)
    shared = words(rng, 12)
    texts = [" ".join(words(rng, 20, 9000) + shared + words(rng, 20, 9000)) for _ in range(12)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substring_dedup.removed_words(make(spark, texts), 8))}
    assert got == dict(enumerate(brute_repeats(texts, 8))) and seen and min(seen) == substring_dedup.FAN_IN + 1


# --- embeddings ------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16))
    for i in range(60):  # around the threshold
        a, b = rng.integers(0, 150, 2)
        x[a] = x[b] / np.linalg.norm(x[b]) + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.11, 0.13])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [math.nan] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, [math.inf] + [0.0] * 15, 1), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1)]
    rows += [(300, rows[5][1], 1), (301, rows[5][1], 2), (301, rows[5][1], 2), (302, (np.array(rows[5][1]) * 1e-180).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid int").repartition(3)
    ok = [(k, i, np.array(v)) for k, (i, v, _) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = lambda v: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())
    links = defaultdict(list)
    for k, i, v in ok:
        for m, j, w in ok:
            if k != m and len(v) == len(w) and unit(v) @ unit(w) >= 0.9:
                links[k].append(m)
    head = heads([(a, b) for a in links for b in links[a]], range(len(rows)))
    for size in (4096, 16):
        got = rows_of(embeddings.near_duplicates(df, 0.9, block_rows=size))
        least = defaultdict(list)
        for k, (i, _, _) in enumerate(rows):
            least[head[k]].append(i)
        want = sorted((i, len(links[k]), min(least[head[k]])) for k, (i, _, _) in enumerate(rows))
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embeddings.quantise(x)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(near - x @ x.T) <= e[:, None] + e + e[:, None] * e + 1e-12).all()
    tile = embeddings.Tile(q, s, e, np.arange(200), np.ones(200, np.int64))
    for threshold in (-0.2, 0.0, 0.3):
        sure, may = embeddings.sift(tile, tile, threshold)
        linked = x @ x.T >= threshold
        assert (linked[sure]).all() and not linked[~sure & ~may].any() and 0 < may.sum() < may.size / 10
    wide = rng.integers(-127, 128, (5, 5000)).astype(np.int8)
    assert (embeddings.products(wide, wide) == wide.astype(np.int64) @ wide.T.astype(np.int64)).all()


# --- URLs ------------------------------------------------------------------

URLS = [
    None, "", "nothing", "http://example.com/en/7", "https://a.example.com/en/712?x", "https://EXAMPLE.com/en/8", "ftp://b.net/de/8", "http://x.example.net/de/81#a", "http://example.net/de/9",
    "http://notexample.com/fr/1", "http://org/es/", "http://a.org/ES/", "http://www.bad.example.com/fr/5/?utm_source=x", "https://bad.example.com/fr/5.html", "https://bad.example.com:443/fr/5?b=1&a=2", "https://bad.example.com/fr/6",
    "://bad.example.com/fr/5", "http://com", "http://?q", "a://b://c/d", "http://bad.example.com/fr/5?a=2&b=1&utm_x=3", "http://com/en/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(3, URLS[3], 1)], "page_id long, url string, block int")
    listed = spark.createDataFrame([("http://bad.example.com/fr/5",), ("x://www.bad.example.com/fr/5?a=2&b=1",), (None,), ("none",)], "url string")
    rules = [urls.rule("block", "com/en/"), urls.rule("allow", "example.com/en/7"), urls.rule("block", "net/de/"), urls.rule("block", "example.net/de/8"), urls.rule("block", "org/es/")]
    got = {r["page_id"]: r for r in rows_of(urls.judge_urls(pages, rules, listed))}
    want = {3: ("example.com/en/7", "allow"), 4: ("example.com/en/7", "allow"), 5: ("com/en/", "block"), 6: ("net/de/", "block"), 7: ("example.net/de/8", "block"), 8: ("net/de/", "block"), 9: (None, "allow"), 10: ("org/es/", "block"), 11: (None, "allow"), 12: (None, "block"), 13: (None, "block"), 14: (None, "block"), 15: (None, "allow"), 16: (None, "block"), 20: (None, "block"), 21: ("com/en/", "block")}
    for i, (rule, verdict) in want.items():
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, verdict), URLS[i]
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 2, 5, 17, 18, 19)] == [("", ""), ("", ""), ("", ""), ("example.com", "/en/8"), ("com", ""), ("", ""), ("b:", "//c/d")]
    assert urls.judge_urls(pages, rules, listed).count() == len(URLS) + 1
    assert {r["verdict"] for r in rows_of(urls.judge_urls(pages, [], listed.limit(0)))} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules, listed).count() == 0


def test_bloom_filter(spark):
    """No listed key is missed, and few others are let through."""
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom, blocks = urls.build_filter(keys, "k", 4000)
    assert urls.probe(keys, "k", bloom, blocks).where("not _maybe").count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("k"))
    assert urls.probe(others, "k", bloom, blocks).where("_maybe").count() < 100


# --- classifiers -----------------------------------------------------------


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    m = quality_classifier.Machine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    sizes = np.array([5, 1, 9])
    index, value = np.concatenate([rng.choice(30, n, replace=False) for n in sizes]), rng.normal(size=15)
    want, at = [], 0
    for n in sizes:
        i, x = index[at : at + n], value[at : at + n]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(n) for b in range(a))
        want.append(0.3 + m.linear[i] @ x + pairs)
        at += n
    assert np.allclose(m.raw(index, value, sizes), want)


@pytest.mark.parametrize(("name", "label", "parts", "held"), [("op5_quality_classifier", "quality", 5, 0), ("op8_toxicity", "toxic", 4, 2)])
def test_classifiers_hold_out(spark, name, label, parts, held):
    from tellura.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in rows_of(queries.QUERIES[name](spark, sf))}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % parts == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    pairs = [(got[r["doc_id"]]["score"], r[label]) for r in rows_of(spark.read.parquet(f"{sf}/labels.parquet")) if got[r["doc_id"]]["held_out"]]
    up, down = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down]) > (0.95 if label == "quality" else 0.75)


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6, 12)], "doc_id long, quality int, toxic int")
    machine = quality_classifier.fit(odd, labels)
    model = toxicity.fit(odd, labels)
    for scored in (quality_classifier.score(odd, machine), toxicity.score(odd, model)):
        assert scored.count() == odd.count() and scored.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert quality_classifier.score(odd, quality_classifier.fit(odd, labels.limit(0))).count() == odd.count()
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).count() == odd.count()
    assert toxicity.score(odd.limit(0), model).count() == 0 and quality_classifier.score(odd.limit(0), machine).count() == 0


def test_viterbi_against_all_paths():
    """The decoded word is that of the best of all paths through the lattice, under a random character model."""
    rng = np.random.default_rng(8)
    model = np.log(rng.dirichlet(np.full(toxicity.CLASSES, 0.3), (toxicity.CLASSES, toxicity.CLASSES)) + 1e-9).astype(np.float32)

    def paths(core, at, before, p2, p1):
        if at == len(core):
            yield float(model[p2, p1, 0]), ""
            return
        c = core[at]
        if c.isalpha():
            steps = [(c, 0.0)] + ([("", toxicity.REPEAT)] if c == before else [])
        else:
            steps = [(x, toxicity.SUBSTITUTE) for x in toxicity.SIGNS.get(c, "")]
            steps.append(("", toxicity.REPEAT if c == before else toxicity.GAP if c in toxicity.SEPARATORS else toxicity.DROP))
        for letter, cost in steps:
            k = toxicity.CLASS.get(letter, toxicity.OTHER)
            gain = toxicity.LETTER + float(model[p2, p1, k]) if letter else 0.0
            for score, word in paths(core, at + 1, c, *((p1, k) if letter else (p2, p1))):
                yield score - cost + gain, letter + word

    cores = ["".join(rng.choice(list("abist01!|@68-.$"), int(rng.integers(1, 9)))) for _ in range(120)] + ["1d1ot", "aabb", "s-t-u", "888", "$$1ss"]
    for core in cores:
        best = {}
        for score, word in paths(core, 0, "", 0, 0):
            best[word] = max(score, best.get(word, -np.inf))
        top = max(best.values())
        assert best[toxicity.decode(core, model)] == pytest.approx(top, abs=1e-4), core


def test_labelled_sample_is_bounded(spark):
    """Ids that repeat in labels or documents add no rows; an id with both labels is one of label 1."""
    from tellura.llm.common import labelled

    docs = spark.createDataFrame([(i % 20, f"t{i}") for i in range(60)] + [(None, "x")], "_id long, _text string")
    labels = spark.createDataFrame([(i % 20, int(i % 20 < 8)) for i in range(80)] + [(0, 0), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows, totals = labelled(docs, labels, 5, "doc_id", "toxic")
    assert Counter(r["y"] for r in rows_of(rows)) == {0: 5, 1: 5} and totals == {0: 12, 1: 8}
    every, _ = labelled(docs, labels, 100, "doc_id", "toxic")
    assert sorted(r["_text"] for r in rows_of(every)) == sorted(min(f"t{i + 20 * k}" for k in range(3)) for i in range(20))


def test_deobfuscation(spark):
    """Insults in leetspeak, stretched and spaced out are scored as the plain words are."""
    rng = np.random.default_rng(4)
    bad = ["idiot", "stupid", "moron", "worthless"]
    plain = ["the", "water", "runs", "over", "green", "hills", "and", "people", "stand", "near", "old", "houses", "reading", "letters"]
    texts, toxic = [], []
    for i in range(300):
        w = list(rng.choice(plain, 30))
        if i % 5 == 0:
            for b in rng.choice(bad, 3, replace=False):
                w.insert(int(rng.integers(0, len(w))), str(b))
        texts.append(" ".join(w))
        toxic.append(int(i % 5 == 0))
    docs = make(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame([(i, t) for i, t in enumerate(toxic)], "doc_id long, toxic int"))
    restorer = toxicity.Restorer(model.characters)
    assert [restorer[w] for w in (b"1d1ot", b"$tup1d", b"m0r0n", b"stuuuupid", b"w.o.r.t.h.l.e.s.s", b"water", b"hills,", b"id!ot!!")] == ["idiot", "stupid", "moron", "stupid", "worthless", "water", "hills", "idiot"]
    hidden = ["the water 1d1ot runs $tup1d over m0r0n green", "the i d i o t water s t u p i d runs m o r o n", "iddiiioot stuuuupid mooooron", "the water runs over green hills and people", "w0rthl3ss id10t people stand near", ""]
    got = [r["_score"] for r in sorted(rows_of(toxicity.score(make(spark, hidden), model)), key=lambda r: r["doc_id"])]
    assert all(s >= 0.3 for s in (got[0], got[1], got[2], got[4])) and got[3] < 0.3 and got[5] < 0.3


# --- packing ---------------------------------------------------------------


def test_packing(spark, odd):
    rng = np.random.default_rng(6)
    texts = odd_texts() + [" ".join(words(rng, int(n), 9000)) for n in rng.integers(1, 700, 150)] + ["it's <|endoftext|> don't", "Ünïcödé İstanbul ΣΑΣ １２３ ½", "the***!! --- 'sup"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = rows_of(packing.pack_documents(make(spark, texts), TOKENIZER, 512))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert sorted(by) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in parts] == [(k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1.01 * sum(r["length"] for r in got) / 512 + 3
    assert packing.pack_documents(odd, TOKENIZER).select("sequence_id", "offset").distinct().count() == packing.pack_documents(odd, TOKENIZER).count()
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def test_genetic_operators():
    rng = np.random.default_rng(0)
    cell = packing.Cell(rng.integers(1, 60, 300), 100, rng)
    a, b = cell.start(0.0), cell.start(0.3)
    for _ in range(50):
        for child in (cell.cross(a, b), cell.shake(a)):
            assert (child >= 0).all() and cell.fills(child).max() <= 100 and (cell.fills(child) > 0).all()
    best = cell.evolve([b], packing.Evolution())[0]
    assert cell.score(best) >= cell.score(b)


# --- mixing ----------------------------------------------------------------


def test_mixing(spark, odd):
    texts = ["x" * 100] * 600
    docs = make(spark, texts, lambda i: "big" if i % 6 else (None if i % 12 else "small"))
    got = rows_of(mixing.replicate(docs, {"big": 1.0, "small": 1.0, None: 2.0}))
    rates = {"big": 0.25 / (500 / 600), "small": 0.25 / (50 / 600), None: 0.5 / (50 / 600)}
    copies = Counter(r["doc_id"] for r in got)
    for i in range(600):
        rate = rates["big" if i % 6 else (None if i % 12 else "small")]
        u = (int(hashlib.md5(f"{i}/0/count".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total < u:
            k += 1
            p *= rate / k
            total += p
        assert copies[i] == k
    assert all(r["_rate"] == pytest.approx(rates[r["source"]]) for r in got)
    assert sorted(r["_copy"] for r in got if r["doc_id"] == 12) == list(range(copies[12]))
    share = Counter(r["source"] for r in got)
    assert share[None] / len(got) == pytest.approx(0.5, abs=0.06)
    assert len({r["_shuffle_key"] for r in got}) == len(got)
    none = mixing.replicate(docs, {"big": 0.0, "small": 1.0})
    assert none.where("source = 'big' or source is null").count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(docs, {"big": -1.0})
    clashing = odd.select("*", *[F.lit(7).alias(c) for c in ("_table", "_name", "_u", "_n", "row", "id", "name", "u", "n", "copy", "order", "table", "rate", "a.b")])
    got = rows_of(mixing.replicate(clashing))
    assert set(got[0]) == {*clashing.columns, "_rate", "_shuffle_key"} and all(r[c] == 7 for r in got for c in ("_table", "_name", "_u", "_n", "row", "id", "name", "u", "n", "copy", "order", "table", "rate", "a.b"))
    assert mixing.replicate(odd.limit(0)).count() == 0


def test_poisson_tables(spark):
    for rate in (0.0, 0.3, 4.0, 60.0):
        table = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).first()["t"]
        p = [math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else 1.0 for k in range(len(table))]
        assert table == pytest.approx(np.cumsum(p).tolist(), abs=1e-12) and table[-1] > 1 - 1e-12
