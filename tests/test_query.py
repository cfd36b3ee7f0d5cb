"""The query language and its plans on a corpus small enough to check by hand."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import kwic, stats, vectors
from textloom.operators.search import describe, hit_count, scored, search, totals
from textloom.plans import query as q
from textloom.sources.corpus import Corpus, FieldInfo, Level, Registry, read_metadata

TEXTS = {1: "a b c", 2: "b a a", 3: "c x y a b", 4: "A, b! (c)", 5: "", 6: "abc abd xbc"}


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(k, t, k % 2, ["x", "y"] if k < 3 else [], None if k == 3 else float(k)) for k, t in TEXTS.items()]
    docs = spark.createDataFrame(rows, "id long, text string, odd int, tags array<string>, size double")
    fine = docs.select("id", F.posexplode(F.split("text", " ")).alias("part", "text"))
    return Corpus(spark, "tiny", [Level("DOC", ["id"], lambda: docs), Level("PART", ["id", "part"], lambda: fine)], default_level="DOC")


CASES = {
    "a": {1: 1, 2: 2, 3: 1, 4: 1},
    "a b": {1: 2, 2: 3, 3: 2, 4: 2},
    "a OR x": {1: 1, 2: 2, 3: 2, 4: 1},
    "a AND NOT c": {2: 2},
    "+a b": {1: 1, 2: 1, 3: 1, 4: 1},
    "a^0 b": {1: 1, 2: 1, 3: 1, 4: 1},
    "a^0": {1: 3, 2: 3, 3: 5, 4: 3},
    "-a": {5: 0, 6: 3},
    "*": {1: 3, 2: 3, 3: 5, 4: 3, 5: 0, 6: 3},
    "": {1: 3, 2: 3, 3: 5, 4: 3, 5: 0, 6: 3},
    '"a b"': {1: 1, 3: 1, 4: 1},
    '"b a"~0': {2: 1},
    '"a c"~1': {1: 1, 4: 1},
    '"c a"~-3': {1: 1, 3: 1, 4: 1},
    '"c b"~-2': {1: 1, 4: 1},
    '"(x OR c) y"~1': {3: 2},
    '"a b c"~-1': {1: 1, 4: 1},
    "ab*": {6: 2},
    "?bc": {6: 2},
    "/ab[cd]/": {6: 2},
    "abc~1": {6: 3},
    "acb~1": {6: 1},
    "acb~1:1:false": {},
    "[ab TO b]": {1: 1, 2: 1, 3: 1, 4: 1, 6: 2},
    "A": {},
    "odd:1 a": {1: 2, 3: 2},
    "tags:x": {1: 1, 2: 1},
    "size:{1 TO 4]": {2: 1, 4: 1},
    "size:* -a": {5: 1, 6: 1},
    "(a c) OR abc": {1: 2, 3: 2, 4: 2, 6: 1},
    "<PART§a§DOC>": {1: 1, 2: 1, 3: 1, 4: 1},
    "<PART§a b§DOC>": {},
    "<DOC§x§tags>": {},
    "<DOC§odd:1 tags:x§tags>": {1: 1, 2: 1},
    "b -<PART§c§DOC>": {2: 1},
    "<DOC§<PART§x§DOC>§DOC> a": {3: 2},
    "(<PART§x§DOC> OR abc)^2": {3: 1, 6: 1},
}


@pytest.mark.parametrize("query", CASES)
def test_hits_and_scores(tiny, query):
    assert {r.id: r.score for r in scored(tiny, query).collect()} == CASES[query]


def test_coarse_condition_at_a_fine_level(tiny):
    rows = scored(tiny, "<DOC§a c§PART> b", "PART").collect()
    assert sorted((r.id, r.part) for r in rows) == [(1, 1), (3, 4), (4, 1)]
    assert scored(tiny, "<DOC§a c§PART> b", "PART", coarse_and_at_fine_rows=True).count() == 0


def test_pages_bands_and_totals(tiny):
    assert [r.id for r in search(tiny, "a", limit=2).collect()] == [2, 1]
    assert [r.id for r in search(tiny, "a", limit=2, offset=2).collect()] == [3, 4]
    assert [r.id for r in search(tiny, "a", sort=[("size", "D", False)], fields=["size"]).collect()] == [3, 4, 2, 1]
    assert [r.id for r in search(tiny, "a", sort=[("size", "A", False)], limit=-1).collect()] == [1, 2, 4, 3]
    assert {r.id for r in scored(tiny, "a", min_score=2).collect()} == {2}
    assert {r.id for r in scored(tiny, "a", max_score=1).collect()} == {1, 3, 4}
    assert tuple(totals(scored(tiny, "a")).first()) == (4, 5.0)
    assert hit_count(tiny, "a").first()[0] == 4 and hit_count(tiny, "a", literal=True).first()[0] == 5
    with pytest.raises(ValueError):
        search(tiny, "a", fields=["nothing"])


@pytest.mark.parametrize("text", ['"a', "(a", "/a", "x:", "<A§b>", "a)", "n:[1 2]", "x^y"])
def test_bad_queries(text):
    with pytest.raises(q.QueryError):
        q.parse(text)


@pytest.mark.parametrize("pattern", ["a~b", "a&b", "x<1-3>", "@"])
def test_operators_of_another_dialect_are_refused(pattern):
    with pytest.raises(q.QueryError):
        q.checked_regex(pattern)
    assert q.checked_regex(r"a\~b") == r"^(?:a\~b)$"


def test_parts_of_a_tree():
    assert q.parse("a") == q.Term(None, "a") and q.parse("f:a*") == q.Wildcard("f", "a*")
    assert q.parse(r"a\*b") == q.Term(None, "a*b")
    assert q.parse('"a b"~-4').slop == 3 and not q.parse('"a b"~-4').ordered
    assert q.parse("x|infl_en_pre_suf:w") == q.Inflected("x", "en", "w", "pre", "suf")
    assert describe(q.parse('"a (b OR c)"~2')) == '"a (b c)"~2'


def test_grouping(tiny):
    got = {r.odd: (r.doc_freq, r.total_term_freq) for r in stats.grouped_stats(tiny, "a", ["odd"]).collect()}
    assert got == {1: (2, 2), 0: (2, 3)}
    assert stats.query_stats(tiny, "a").first()[:2] == (4, 5)
    by_size = {r.size: r.doc_freq for r in stats.grouped_stats(tiny, "a", ["size"]).collect()}
    assert by_size == {None: 1, 1.0: 1, 2.0: 1, 4.0: 1}


def test_vectors(tiny):
    v = {r.term: r.weight for r in vectors.term_vector(tiny, "x").collect()}
    assert v == dict.fromkeys("cxyab", 1.0)
    docs = tiny.rows().count()
    pmi = {r.term: r.weight for r in vectors.term_vector(tiny, "c", how=vectors.Aggregate("PMI")).collect()}
    import math

    assert pmi["c"] == pytest.approx(math.log(3 * (docs / 3) / 3)) and pmi["x"] == pytest.approx(math.log(1 * (docs / 3) / 1))
    ppmi = vectors.term_vector(tiny, "a", how=vectors.Aggregate("PPMI")).collect()
    assert all(r.weight >= 0 for r in ppmi)
    few = vectors.term_vector(tiny, "*", max_docs=0)
    assert few.count() == 0 and vectors.term_vector(tiny, "*", max_docs=100).count() == tiny.term_stats().count()


def test_kwic(tiny):
    rows = kwic.kwic(tiny, "a", sort=["1AI"], limit=-1).collect()
    assert [(r.id, r.match, r.sort_0) for r in rows] == [(2, "a", ""), (2, "a", "a"), (1, "a", "b"), (3, "a", "b"), (4, "A,", "b")]
    span = kwic.kwic(tiny, '"a b"', limit=-1, sort=["-1A"]).collect()
    assert [(r.id, r.match, r.sort_0) for r in span] == [(1, "a b", ""), (4, "A, b!", ""), (3, "a b", "y")]
    assert {r.snippet for r in kwic.passages(tiny, "a c", "DOCUMENT", "DOC").filter("id = 1").collect()} == {"<b>a</b> b <b>c</b>"}
    assert kwic.passages(tiny, "a c", "WORD", "DOC", join_matches=False).filter("id = 1").count() == 2
    with pytest.raises(ValueError):
        kwic.sort_key("x")


def test_offset_data(spark):
    points = spark.createDataFrame([(1, 5), (1, 1), (2, 3)], "id long, offset int")
    data = spark.createDataFrame([(1, 5, "five"), (1, 7, "seven"), (1, 3, "three")], "id long, offset int, data string")
    get = lambda mode: {(r.id, r.offset): r.data for r in kwic.offset_data(points, data, ["id"], mode).collect()}
    assert get("EXACT") == {(1, 5): "five", (1, 1): None, (2, 3): None}
    assert get("PREV") == {(1, 5): "five", (1, 1): None, (2, 3): None}
    assert get("NEXT") == {(1, 5): "five", (1, 1): "three", (2, 3): None}


def test_metadata_and_registry(spark, tiny, tmp_path):
    raw = '{"name": "n", "version": "1", "contentField": "text", "contentTokensField": "n", "levels": [{"id": "D", "term": "doc", "index": "d", "fields": {"a": {"storedAs": "NUMERICDOCVALUES"}}}, {"id": "S", "term": "sent", "indices": ["s1", "s2"]}], "commonFields": {"c": {"indexedAs": "STRING"}}}'
    m = read_metadata(raw)
    assert m["defaultLevel"] == "S" and m["levels"][1]["indices"] == ["s1", "s2"] and m["levels"][0]["fields"]["c"].indexed_as == "STRING"
    with pytest.raises(ValueError):
        FieldInfo("x", stored_as="WRONG")
    r = Registry()
    r.open("ok", lambda: tiny)
    r.open("broken", lambda: 1 / 0)
    assert list(r.corpora) == ["ok"] and "broken" in r.warnings and r.listing(spark).count() == 1
    from textloom.sources.corpus import open_corpus

    spark.createDataFrame([(1, "x y")], "doc long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc long, sent long, text string").write.parquet(str(tmp_path / "s1"))
    spark.createDataFrame([(1, 0, "e"), (1, 1, "f")], "doc long, sent long, mark string").write.parquet(str(tmp_path / "s2"))
    c = open_corpus(spark, str(tmp_path), raw)
    assert [r.sent for r in scored(c, "y", "S").collect()] == [1] and "mark" in c.rows("S").columns
    assert [r.doc for r in scored(c, "<S§y§D>", "D").collect()] == [1]
