"""The pipeline against a brute-force version, and the queries' results over whole tables."""

import random
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_filters import brute_groups, brute_learned, brute_score, planted

import __spark_entry__ as entry
from textloom.llm import mixing, oracles, queries, toxicity
from textloom.llm.tokens import tokenizer


def corpus():
    rng = random.Random(9)
    rows = [(i, t, rng.choice("aab")) for i, t in planted(8, 12, 4)]
    rows += [(1000 + k, rows[k][1], "a") for k in range(10)] + [(2000 + k, rows[-1 - k][1] + " you idiot moron", "b") for k in range(5)]
    return [*rows, (3000, None, "a"), (3001, "", "b"), (3002, "", "b"), (None, "no id", "a")]


def brute(rows, beginnings):
    """What is left after each filter."""
    clean = [r for r in rows if r[1] is None or brute_score(r[1], "en", beginnings=beginnings) < toxicity.THRESHOLD]
    first = {}
    for i, t, _ in clean:
        if i is not None and t is not None:
            first[t] = min(first.get(t, i), i)
    single = [r for r in clean if r[0] is None or r[1] is None or first[r[1]] == r[0]]
    groups = brute_groups([(i, t) for i, t, _ in single])[1]
    return clean, single, [r for r in single if groups.get(r[0], r[0]) == r[0]]


def test_stages_against_brute_force(spark, frame, tmp_path):
    rows = corpus()
    docs = frame(rows, extra=False)
    labels = [(i, int("idiot" in (t or ""))) for i, t, _ in rows if i is not None and i % 3 != 1]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    beginnings = brute_learned([(i, "en", t) for i, t, _ in rows], labels)
    wants = brute(rows, beginnings)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 3:
            assert Counter((r.doc_id, r.text, r.source) for r in docs.collect()) == Counter(wants[k])
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if k == 3:
            times = {(r.doc_id, r.source): r.copies for r in mixing.drawn_copies(before).collect()}
            assert Counter(r.doc_id for r in docs.collect()) == Counter({i: times.get((i, s), 1) for i, _, s in wants[2] if times.get((i, s), 1)})
    ids = Counter()
    for s in docs.collect():
        assert len(s.ids) == 2 << s.bucket
        ids[s.doc_id] += s.length
    encode = tokenizer().encoder.encode_ordinary
    assert ids == Counter({i: n * len(encode(t)) for i, t, s in wants[2] if t and (n := times.get((i, s), 1))})


def test_run_is_the_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    key = lambda r: (r.doc_id, r.piece, r.start, bytes(r.ids))
    assert Counter(map(key, out.collect())) == Counter(map(key, docs.collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_an_empty_table(spark, frame, tmp_path):
    docs = frame([], extra=False)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    r = con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    want = Counter(map(str, r.fetchall()))
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(str(tuple(r)) for r in got.select(columns).collect()) == want and want


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_op1_op2_op5_op6_op7_cover_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = docs.count()
    q = queries.queries()
    assert q["op1_mix_sources"](spark, data).count() == n == q["op7_lm_scores"](spark, data).count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    encode = tokenizer().encoder.encode_ordinary
    total = sum(len(encode(t)) for t in texts.values())
    assert sum(r.n_ids for r in q["op2_token_planes"](spark, data).select("n_ids").collect()) == total
    assert sum(r.length for r in q["op5_pack"](spark, data).select("length").collect()) == total
    assert {r.doc_id for r in q["op6_licences"](spark, data).collect()} <= set(texts)


def test_tokens_equal_the_encoder():
    rng = random.Random(2)
    odd = ["", " ", "\n\n a", "it's I'LL we've 'sx 'tis", "a  b   c\t\td", "x" * 5000, "1234 ½ Ⅷ ٣", "漢字かな\U0001f600 é́", "don''t", " a  b", "'s's"]
    odd += ["".join(rng.choices("ab 'stre\n\t1é漢., ", k=200)) for _ in range(200)]
    encoder = tokenizer().encoder
    ids, starts = tokenizer().encode(odd)
    assert [list(ids[a:b]) for a, b in zip(starts[:-1], starts[1:])] == [encoder.encode_ordinary(t) for t in odd]
    long = "".join(rng.choices("ab 'stre\n1é", k=700_000))
    assert (tokenizer().encode([long])[0] == np.array(encoder.encode_ordinary(long))).all()
