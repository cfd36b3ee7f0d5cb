"""Cases of reviews: each failed before."""

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.catalogue import QUERIES, SQL
from textloom.functions import text as tx
from textloom.functions.fuzzy import restricted_distance, swap_distance, within_edits
from textloom.operators import kwic
from textloom.sources.corpus import Corpus, Level

WORDS = ["of", "the", "orre", "Orre.", "(of", "the)", "edea", "or-", "--", "there", "hxtere", "thier", "straße", "ΟΔΟΣ", "İX", "x\x0by"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of documents with words at which Spark's functions and SQL's differ, twice the same key, and null and empty texts."""
    path = tmp_path_factory.mktemp("odd")
    texts = [" ".join(WORDS[(i * k + k * k) % len(WORDS)] + ("\n" if k % 7 == 6 else "") for k in range(40)) for i in range(60)]
    texts += [None, "", " \n", "orre straße. ŉ orre!", " orre a . orre　", "\torre b ", "of the. orre of\nthe orre of the"]
    rows = [(i, t, ("en", "fr")[i % 2], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def differences(spark, path, name, sql=None):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, path)
    columns = sorted(got.columns)
    r = con.execute(sql or SQL[name])
    names = [d[0] for d in r.description]
    want = Counter(tuple(x[names.index(c)] for c in columns) for x in r.fetchall())
    assert want
    have = Counter(tuple(x) for x in got.select(*[f"`{c}`" for c in columns]).collect())
    return have - want, want - have


@pytest.mark.parametrize("name", "match_transform similar_terms_fuzzy".split())
def test_rows_of_odd_words_are_those_of_sql(spark, odd, name):
    assert differences(spark, odd, name) == (Counter(), Counter())


def test_capitals_and_trimmed_ends_of_all_letters(spark):
    cases = [c for c in map(chr, range(1, 0x11000)) if not 0xD800 <= ord(c) < 0xE000] + ["straße ΟΔΟΣ", " a ", "　b \n", "\ta "]
    want = {c: (u, t) for c, u, t in duckdb.from_arrow(pa.table({"c": cases})).query("t", "select c, upper(c), trim(c) from t").fetchall()}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", tx.capitals(F.col("c")), tx.trimmed(F.col("c"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


@settings(deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_swaps_with_letters_between(a, b):
    assert swap_distance(a, b) == duckdb.connect().execute(f"select damerau_levenshtein('{a}', '{b}')").fetchall()[0][0] <= restricted_distance(a, b)


def test_fuzzy_terms_hold_swaps_with_letters_between(spark):
    terms = ["ca", "abc", "acxb", "there", "hxtere", "txhere", "thre", "thxxr", "ehtre"]
    got = {r.t for r in spark.createDataFrame([(t,) for t in terms], "t string").filter(within_edits(F.col("t"), "there", 2)).collect()}
    assert got == {r[0] for r in duckdb.from_arrow(pa.table({"t": terms})).query("x", "select t from x where damerau_levenshtein(t, 'there') <= 2").fetchall()} >= {"hxtere"}


@pytest.mark.parametrize("name", "tokenize doc_vector sub_nested sub_fine_to_coarse kwic_sorted kwic_page stats_transform vec_join fuzzy_extended span_match span_match_words render_match passages_per_match similar_terms_general colloc_flat places group_key_union unit_token unit_word".split())
def test_rows_of_odd_texts_are_those_of_sql(spark, odd, name):
    assert differences(spark, odd, name) == (Counter(), Counter())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_and_places_are_found_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b\n", 0), (2, "a c- d", 0)], "doc_id long, text string, x int")
    for found in (tx.tokens(docs, ["doc_id"]), tx.tokens_with_places(docs, ["doc_id"]), tx.term_counts(docs, ["doc_id"])):
        assert not re.search("Exchange|Window|Sort", plan(found))
    assert sorted(map(tuple, tx.term_counts(docs, ["doc_id"]).collect())) == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "cd", 1)]
    assert [tuple(r) for r in tx.tokens_with_places(docs, ["doc_id"], only=["cd"]).collect()] == [(2, 1, "cd", 2, 6)]


def test_rows_with_the_same_keys_are_counted_together(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, None)], "doc_id long, text string")
    c = Corpus(spark, "same-keys", [Level("DOCUMENT", ["doc_id"], lambda: docs)])
    assert sorted(map(tuple, c.doc_terms().collect())) == [(1, "a", 2), (1, "b", 1)]


def test_terms_are_sorted_in_runs_over_batches(spark, monkeypatch):
    monkeypatch.setattr(tx, "_PAIRS", 7)
    batches = [[(1, "d c"), (2, "b a")], [(3, ""), (4, "c c a b d e f")], [(5, "a")]]
    docs = spark.createDataFrame([x for b in batches for x in b], "doc_id long, text string").coalesce(1)
    taken = {}
    monkeypatch.setattr(tx, "_mapped", lambda units, keys, text, found, kinds: taken.update(found=found))
    tx.term_counts(docs, ["doc_id"])
    pairs = ((pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in b]}), iter([t for _, t in b])) for b in batches)
    runs = [[(own.column(0)[k].as_py(), t, n) for k, t, n in zip(at.to_pylist(), terms.to_pylist(), tf.to_pylist())] for own, at, terms, tf in taken["found"](pairs)]
    assert [[t for _, t, _ in r] for r in runs] == [sorted(t for _, t, _ in r) for r in runs] and len(runs) == 2
    assert sorted(x for r in runs for x in r) == sorted((i, t, n) for b in batches for i, text in b for t, n in Counter(text.split()).items())


def test_places_of_few_rows_are_made_from_their_text_alone(spark, odd):
    from textloom.sources.corpus import documents_corpus

    c = documents_corpus(spark, odd)
    asked = []
    c.places = lambda *x: asked.append(x)
    assert kwic.kwic(c, "orre", "SENTENCE", ["1AI"], limit=3).count() == 3 and kwic.matches(c, '"of the"').count() > 0 and not asked


def test_units_of_long_texts_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tx, "_ROWS", 10)
    taken = {}
    monkeypatch.setattr(tx, "_mapped", lambda units, keys, text, found, kinds: taken.update(found=found))
    for unit, n in (("WORD", 25), ("TOKEN", 49)):
        tx.unit_rows(spark.createDataFrame([(1, "")], "doc_id long, text string"), unit)
        parts = list(taken["found"]([(None, iter(["a " * 24 + "a"]))]))
        assert max(len(p[1]) for p in parts) == 10 and [k for p in parts for k in p[2].to_pylist()] == list(range(n))


def test_hits_and_words_are_sent_to_what_they_meet(spark, odd):
    from textloom.operators import similar, vectors
    from textloom.sources.corpus import documents_corpus

    c = documents_corpus(spark, odd)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (vectors.term_vector(c, "the"), similar.all_similar_terms(c, "o* th?"), vectors.grouped_vectors(c, "of", ["lang"])):
            assert not re.search("SortMergeJoin.*term|SortMergeJoin.*doc_id", plan(df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
