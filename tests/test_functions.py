"""Facts about vectors, text units, edit distance, places, maps; sinks and the stream."""

import json
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import distance as dist
from textloom.functions import geo
from textloom.functions import text as tx
from textloom.functions.fuzzy import restricted_distance
from textloom.operators import info, kwic, reduce, squares, stats, vectors
from textloom.sources import sinks
from textloom.sources.corpus import Corpus, Level, documents_corpus
from textloom.streaming.drift import term_drift

VECTORS = {
    "x": {1: 3, 2: 1, 3: 2, 4: 2, 5: 1}, "y": {1: 3, 3: 2, 4: 1, 6: 1, 7: 5}, "z": {6: 1, 7: 5}, "z2": {6: 3, 7: 7}, "z3": {6: 2, 7: 10}, "z4": {6: 2, 7: 10}, "z5": {6: 1, 7: 5}, "z6": {6: 3, 7: 7},
}


@pytest.fixture(scope="module")
def vec(spark):
    rows = spark.createDataFrame([(v, t, float(w)) for v, ws in VECTORS.items() for t, w in ws.items()], "vec string, term long, weight double")
    return lambda name: rows.filter(F.col("vec") == name).select(F.lit(1).alias("k"), "term", "weight")


def cosine(a, b, filtering="EITHER", mode="NONE"):
    return 1 - dist.distances(a, b, ("COSINE",), filtering, mode, ("k",)).first().cosine if dist.joined(a, b, ["k"], ["k"], filtering).count() else 0.0


@pytest.mark.parametrize(
    ("a", "b", "filtering", "prepare", "want"),
    [
        ("z", "z3", "BOTH", "raw", 1), ("x", "x", "EITHER", "raw", 1), ("y", "y", "BOTH", "raw", 1), ("y", "z", "BOTH", "raw", 1), ("y", "z", "RIGHT", "raw", 1),
        ("x", "z", "EITHER", "raw", 0), ("x", "z", "BOTH", "raw", 0), ("x", "z", "LEFT", "raw", 0), ("x", "z", "RIGHT", "raw", 0),
        ("x", "x", "BOTH", "center", 1), ("y", "y", "EITHER", "center", 1), ("x", "z", "EITHER", "center", 0), ("z", "z2", "BOTH", "center", 1),
        ("z4", "z5", "BOTH", "raw", 1), ("z4", "z5", "BOTH", "normalize", 1), ("z4", "z5", "BOTH", "both", 1), ("z4", "z6", "BOTH", "both", 1),
    ],
)
def test_cosines(vec, a, b, filtering, prepare, want):
    steps = {"raw": lambda v: v, "center": lambda v: dist.center(v, ["k"]), "normalize": lambda v: dist.normalize(v, ["k"]), "both": lambda v: dist.center(dist.normalize(v, ["k"]), ["k"])}
    assert cosine(steps[prepare](vec(a)), steps[prepare](vec(b)), filtering) == pytest.approx(want, abs=1e-6)


def test_pairs_equal_single_distances(spark, vec):
    rows = None
    for n in VECTORS:
        v = vec(n).select(F.lit(n).alias("vec"), F.col("term").cast("string").alias("term"), "weight")
        rows = v if rows is None else rows.unionByName(v)
    for m in dist.METRICS:
        got = {(r.left, r.right): r.distance for r in dist.pairwise(rows, "vec", m).collect()}
        assert len(got) == 28
        for a, b in (("x", "y"), ("x", "z"), ("z4", "z6")):
            x, y = VECTORS[a], VECTORS[b]
            terms = x.keys() | y.keys()
            p = [(x.get(t, 0), y.get(t, 0)) for t in terms]
            want = {
                "COSINE": 1 - sum(i * j for i, j in p) / math.sqrt(sum(i * i for i, _ in p) * sum(j * j for _, j in p)), "EUCLIDEAN": math.sqrt(sum((i - j) ** 2 for i, j in p)),
                "MANHATTAN": math.sqrt(sum(abs(i - j) for i, j in p)), "JACCARD": 1 - sum(map(min, p)) / sum(map(max, p)), "DICE": 1 - 2 * sum(map(min, p)) / sum(map(sum, p)),
            }[m]
            assert got[a, b] == pytest.approx(want)


TWEET = "@theresa_may @theresa_may, today anything you say is just to distract from the overwhelming success of the #Brexit… https://t.co/0rr5e2WMRp"


@pytest.mark.parametrize(
    ("unit", "left", "right", "at", "want"),
    [("WORD", 0, 0, 16, "theresa_may"), ("TOKEN", 0, 0, 16, "theresa_may"), ("WORD", 2, 2, 16, "@theresa_may @theresa_may, today anything"), ("TOKEN", 1, 1, 16, "@theresa_may,"), ("TOKEN", 2, 2, 16, " @theresa_may, "), ("TOKEN", 3, 3, 16, "theresa_may @theresa_may, today"), ("WORD", 1, 1, 16, "theresa_may @theresa_may, today"), ("WORD", 2, 0, 16, "@theresa_may @theresa_may"), ("WORD", 0, 2, 16, "theresa_may, today anything"), ("WORD", 0, 0, 38, "anything")],
)
def test_units(unit, left, right, at, want):
    a, b = tx.expanded_span(TWEET, unit, at, left, right)
    assert TWEET[a:b] == want
    own = tx.Units(TWEET, unit, left, right)
    assert TWEET[max(own.preceding(at + 1), 0) : own.following(at)] == want


def test_moves_over_units():
    own = tx.Units(text := "0 2.!.6 8 A C E", "CHARACTER")
    assert text[own.following(3) : own.next()] == "!"
    own = tx.Units(text, "CHARACTER", 2, 2)
    assert text[own.following(3) : own.next()] == "6 8"
    own = tx.Units(text, "WORD")
    assert text[own.preceding(3) : own.next()] == "2"
    own = tx.Units(TWEET, "WORD", 0, 2)
    assert TWEET[own.following_word_start(16) : own.next()] == "today anything you"
    own = tx.Units(TWEET, "WORD")
    assert TWEET[own.following_word_start(16) : own.next()] == "today"
    for moves, want in ((1, "anything"), (2, "you")):
        own.following_word_start(16)
        at = [own.next_word_start() for _ in range(moves)][-1]
        assert TWEET[at : own.next()] == want
    for moves, want in ((0, "anything"), (1, "today"), (2, "theresa_may")):
        at = [own.preceding(38), *(own.previous() for _ in range(moves))][-1]
        assert TWEET[at : own.next()] == want
    assert tx.Units("", "WORD").next() == tx.Units("", "WORD").previous() == tx.Units("a", "TOKEN").following(1) == tx.Units.DONE


def test_characters_and_paragraphs(spark):
    text = "0 2.!.6 8 A C E"
    assert text[slice(*tx.expanded_span(text, "CHARACTER", 4))] == "!" and text[slice(*tx.expanded_span(text, "CHARACTER", 6, 2, 2))] == "!.6 8"
    docs = spark.createDataFrame([(1, "a\nb\n\nc\n\n\nd", 0), (2, "", 0)], "doc_id long, text string, x int")
    assert [r.text for r in tx.segments(docs, ["doc_id"], "PARAGRAPH").orderBy("doc_id", "seg").collect()] == ["a\nb", "c", "d", ""]
    spans = [(r.start, r.end) for r in tx.unit_rows(docs, "PARAGRAPH").orderBy("seg").collect()]
    assert spans == [(0, 5), (5, 9), (9, 10)]


def test_terms(spark):
    docs = spark.createDataFrame([(1, "Hyphen-\nated  word -- (Quoted) - x-y  "), (2, "  "), (3, None), (4, "\n a")], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.term) for r in tx.tokens(docs, ["doc_id"]).orderBy("doc_id", "pos").collect()] == [(1, 0, "hyphenated"), (1, 1, "word"), (1, 2, "quoted"), (1, 3, "x-y"), (4, 0, "a")]
    places = tx.tokens_with_places(docs, ["doc_id"]).orderBy("doc_id", "pos").collect()
    assert [(r.term, r.start, r.end) for r in places if r.doc_id == 4] == [("a", 2, 3)]
    assert [r.term for r in places if r.doc_id == 1] == ["hyphenated", "word", "quoted", "x-y"]


@settings(deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distance(a, b):
    d = restricted_distance(a, b)
    assert d == restricted_distance(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert d >= duckdb.connect().execute(f"select damerau_levenshtein('{a}', '{b}')").fetchall()[0][0]


def test_places(spark):
    df = spark.createDataFrame([(60.17, 24.94), (0.0, 179.0), (10.0, 10.0)], "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    assert df.select(geo.distance(lat, lon, 59.33, 18.07)).first()[0] == pytest.approx(396_000, rel=0.01)
    assert [r[0] for r in df.select(geo.query(lat, lon, "-5,170,5,-170")).collect()] == [False, True, False]
    assert [r[0] for r in df.select(geo.query(lat, lon, "0,0,20,0,20,20,0,20")).collect()] == [False, False, True]
    with pytest.raises(ValueError):
        geo.query(lat, lon, "1,2,3,4,5")


def test_maps():
    points = np.random.default_rng(0).normal(size=(12, 2))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    for x in (reduce.classical_mds(d), reduce.stress_mds(d)):
        assert np.allclose(np.linalg.norm(x[:, None] - x[None], axis=2), d, atol=1e-6)
    far = np.kron(1 - np.eye(2), np.ones((8, 8))) * 10 + 0.1 * (1 - np.eye(16))
    y = reduce.tsne(far, steps=300)
    assert np.linalg.norm(y[:8].mean(0) - y[8:].mean(0)) > np.linalg.norm(y[:8] - y[:8].mean(0), axis=1).max()
    noisy = d + np.abs(np.random.default_rng(1).normal(size=d.shape))
    noisy = (noisy + noisy.T) * (1 - np.eye(12))
    assert reduce.stress(noisy, reduce.stress_mds(noisy)) <= reduce.stress(noisy, reduce.classical_mds(noisy)) + 1e-9
    assert reduce.classical_mds(np.zeros((1, 1))).shape == (1, 2)


def test_quantiles_and_histograms(spark):
    rows = spark.createDataFrame([(float(k) if k % 2 else None,) for k in range(100)], "v double")
    q = {r.p: r.value for r in info.quantiles(rows, "v", [0, 0.5, 1], exact=True).collect()}
    assert q == {0: 0, 0.5: 0.5, 1: 99}
    h = info.histogram(rows, "v", 10).orderBy("bin").collect()
    assert sum(r.n for r in h) == 100 and h[-1].high == 99 and sum(r.proportion for r in h) == pytest.approx(1)
    one = info.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v", 2).collect()
    assert [r.n for r in sorted(one)] == [4, 0]
    assert info.quantile_label(0.25, "0.01") == "0.25" and info.quantile_label(0.5, "0.1") == "0.5"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 2.0), (2, None, 3.0)], "id long, s string, score double")
    assert json.loads(sinks.as_json(df, {"query": "x"}).first().json) == {"queryMetadata": {"query": "x"}, "result": {"id": 1, "s": 'a "b", c', "score": 2.0}}
    assert [r.line.split(",")[-1] for r in sinks.as_csv(df).collect()] == ["2", "3"]
    with pytest.raises(ValueError):
        sinks.as_csv(df.select(F.array("id").alias("x")))
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    cache, calls = sinks.ResultCache(spark, str(tmp_path / "cache")), []

    def compute():
        calls.append(1)
        return df

    key = sinks.call_id("m", "c", "1", {"b": 1, "a": 2})
    assert key == sinks.call_id("m", "c", "1", {"a": 2, "b": 1}) != sinks.call_id("m", "c", "2", {"a": 2, "b": 1})
    assert cache.get(key, compute).count() == 2 == cache.get(key, compute).count() and len(calls) == 1
    cache.get(key, compute, force=True)
    assert len(calls) == 2 and cache.status[key].error is None and cache.status[key].elapsed >= 0
    with pytest.raises(sinks.TooLarge):
        sinks.limited_size(df, 10)
    assert sinks.limited_size(df) is df and sinks.estimate(df)["bytes"] > 0
    assert sinks.within(spark, 60, df.count) == 2


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a b a"), ("2024-01-02 10:00:00", "a"), ("2024-01-09 10:00:00", "z")], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = term_drift(stream).writeStream.format("memory").queryName("drift").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(str(r.window_start)[:10], r.term): r.tf for r in spark.table("drift").collect()}
    assert got == {("2024-01-01", "a"): 2, ("2024-01-01", "b"): 1, ("2024-01-02", "a"): 1}
    assert term_drift(rows).count() == 4


# ---------------------------------------------------------------- vectors, places, results


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghijkl", weights=range(1, 13), k=rng.randint(1, 30))), rng.choice(["x", "", None])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g string")
    return rows, Corpus(spark, "small", [Level("DOCUMENT", ["doc_id"], lambda: docs)])


def test_similar_collocations_against_loops(small):
    rows, c = small
    docs = [Counter(t.split()) for _, t, _ in rows]
    first = Counter()
    for d in docs:
        if "a" in d:
            first.update(d)
    first = dict(sorted(first.items(), key=lambda x: (-x[1], x[0]))[:3])
    second = {t for d in docs if d.keys() & first.keys() for t in d}
    want = []
    for t in second:
        v = Counter()
        for d in docs:
            if t in d:
                v.update(d)
        p = [(v.get(k, 0), first.get(k, 0)) for k in v.keys() | first.keys()]
        low, total = sum(map(min, p)), sum(map(sum, p))
        cosine = 1 - sum(x * y for x, y in p) / math.sqrt(sum(x * x for x, _ in p) * sum(y * y for _, y in p))
        want += [("cosine", t, cosine), ("dice", t, 1 - 2 * low / total), ("jaccard", t, 1 - low / (total - low)), ("euclidean", t, math.sqrt(sum((x - y) ** 2 for x, y in p))), ("manhattan", t, math.sqrt(sum(abs(x - y) for x, y in p)))]
    for chunk, pairs in ((squares.CHUNK, squares.PAIRS), (20, 50)):
        old = squares.CHUNK, squares.PAIRS
        squares.CHUNK, squares.PAIRS = chunk, pairs
        got = vectors.similar_collocations(c, "a", first_limit=3, limit=1000).collect()
        squares.CHUNK, squares.PAIRS = old
        assert {(r.metric, r.term): r.distance for r in got} == {(m, t): pytest.approx(d, abs=1e-8) for m, t, d in want}
    assert vectors.similar_collocations(c, "a", limit=5, third_docs=12 * 20).count() == 25
    assert vectors.similar_collocations(c, "nothing").count() == 0
    with pytest.raises(ValueError, match="no sample"):
        vectors.similar_collocations(c, "a", third_docs=5)
    assert vectors.budget(-1, 5) == -1 and vectors.budget(100, 21) == 4


def test_squared_lengths_of_many_chunks():
    """All that a block holds, in chunks of a few numbers."""
    rng = random.Random(1)
    docs = [(sorted(rng.sample(range(9), 3)), t := sorted(rng.sample(range(40), rng.randint(1, 30))), [float(rng.randint(1, 5)) for _ in t]) for _ in range(50)]
    want = {}
    for b in range(9):
        v = Counter()
        for own, t, f in docs:
            if b in own:
                v.update(dict(zip(t, f)))
        want[b] = sum(x * x for x in v.values())
    batch = pa.RecordBatch.from_pydict({"bases": [b for b, _, _ in docs], "terms": [t for _, t, _ in docs], "freqs": [f for _, _, f in docs]})
    cells = pa.Table.from_batches(list(squares._cells(4)([batch]))).sort_by("cell").combine_chunks()
    for chunk in (10, 1 << 20):
        old, squares.CHUNK = squares.CHUNK, chunk
        got = {k: v for out in squares._squared(iter(cells.to_batches(max_chunksize=7))) for k, v in zip(*(out.column(x).to_pylist() for x in ("base", "ss")))}
        squares.CHUNK = old
        assert got == pytest.approx(want)


def test_distances_of_documents(small):
    rows, c = small
    y = {"a": 2.0, "b": 1.0, "zz": 3.0}
    vector = c.spark.createDataFrame(list(y.items()), "term string, weight double")
    got = {r.doc_id: r.distance for r in vectors.search_distance(c, "a", vector, metric="MANHATTAN").collect()}
    assert got == {i: pytest.approx(math.sqrt(sum(abs(d.get(t, 0) - y.get(t, 0)) for t in d.keys() | y.keys()))) for i, t, _ in rows if "a" in (d := Counter(t.split()))}
    flat = vectors.search_distance(c, "a", vector, local_how=vectors.Local(scaling="FLAT"), normalization="NORMALIZE")
    n = math.sqrt(sum(x * x for x in y.values()))
    for r in flat.collect():
        d = set(rows[r.doc_id][1].split())
        assert r.distance == pytest.approx(1 - sum(y.get(t, 0) for t in d) / math.sqrt(len(d)) / n)


def test_groups_with_null_and_empty_keys_stay_apart(small):
    _, c = small
    groups = [vectors.grouped_vectors(c, w, ["g"]) for w in ("a", "b")]
    assert {r.g for r in vectors.diff_lists(*groups, ["g"], 2).select("g").distinct().collect()} == {None, "", "x"}


def test_places_under_an_analyzer(spark):
    docs = spark.createDataFrame([(1, "One, two ONE"), (2, None), (3, "")], "doc_id long, text string")
    c = Corpus(spark, "analyzed", [Level("DOCUMENT", ["doc_id"], lambda: docs)], analyzers={"text": lambda x: F.split(F.lower(x), "[, ]+")})
    assert [tuple(r) for r in c.places().orderBy("pos").collect()] == [(1, 0, "one", 0, 3), (1, 1, "two", 5, 8), (1, 2, "one", 9, 12)]
    assert [(r.start, r.end) for r in kwic.matches(c, "one").orderBy("start").collect()] == [(0, 3), (9, 12)]


def test_a_rewritten_table_gives_new_results(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    for texts in (["a b"], ["c", "c d"]):
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(path)
        assert {r.term for r in documents_corpus(spark, str(tmp_path)).term_stats().collect()} == set(" ".join(texts).split())


def test_total_beside_limited_groups(small):
    rows, c = small
    out = stats.with_total(c, "a", ["g"], term_freqs=True, limit=1).collect()
    hits = [t.split().count("a") for _, t, _ in rows if "a" in t.split()]
    assert len(out) == 2 and out[-1].is_total and (out[-1].doc_freq, out[-1].total_term_freq, list(out[-1].term_freqs)) == (len(hits), sum(hits), sorted(hits))


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([(2.0, "x")], "score double, g string").coalesce(1)
    for whole, want in ((True, "2,x"), (False, "2.0,x")):
        sinks.write_csv(df, str(tmp_path / str(whole)), whole)
        assert [r.value for r in spark.read.text(str(tmp_path / str(whole))).collect()] == ["score,g", want]
