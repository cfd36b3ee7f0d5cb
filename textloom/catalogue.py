"""A query for every operator, over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance as dist
from .functions import geo
from .functions import text as tx
from .functions.fuzzy import within_edits
from .operators import info, kwic, reduce, similar, stats, vectors
from .operators.search import hit_count, scored, search, totals
from .plans import query as q
from .plans.compile import Compiler, field_semi_join
from .sources import sinks
from .sources.corpus import Corpus, Level, conversations_corpus, documents_corpus
from .sources.store import derived
from .streaming.drift import term_drift

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- SQL parts

STRIP = r"lower(regexp_replace(t, '^[[:punct:]]*(.*?)[[:punct:]]*$', '\1', 's'))"


def tok_sql(name: str, keys: str, source: str) -> str:
    return rf"""{name} AS (SELECT {keys}, pos, term FROM (SELECT {keys}, p - 1 AS pos, {STRIP} AS term FROM (SELECT {keys}, unnest(a) AS t, generate_subscripts(a, 1) AS p
  FROM (SELECT {keys}, regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '-\s+', '', 'g'), '\s+') AS a FROM {source}))) WHERE term <> '')"""


LINES = "lines AS (SELECT source, doc_id, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"
SENTS = "sents AS (SELECT source, doc_id, lang, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS sent_no FROM (SELECT *, regexp_extract_all(text, '[^.!?]+[.!?]*') AS a FROM documents))"
TOK = tok_sql("tok", "doc_id", "documents")
DT = "dt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
TS = "ts AS (SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_term_freq FROM dt GROUP BY term)"
LEN = "len AS (SELECT d.doc_id, coalesce(x.n, 0) AS n_tokens FROM documents d LEFT JOIN (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY 1) x USING (doc_id))"
LTOK = tok_sql("ltok", "doc_id, line_no", "lines")
STOK = tok_sql("stok", "doc_id, sent_no", "sents")
BASE = f"WITH {TOK}, {DT}"
FULL = f"{BASE}, {TS}, {LEN}"
DOCS = "docs AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


def tf(term: str, alias: str = "f") -> str:
    return f"(SELECT doc_id, tf AS {alias} FROM dt WHERE term = '{term}')"


# ---------------------------------------------------------------- sources


def corpus(spark: SparkSession, sf: str) -> Corpus:
    return documents_corpus(spark, sf)


@register("tokenize", f"WITH {TOK} SELECT doc_id, pos, term FROM tok")
def _(spark, sf):
    return corpus(spark, sf).tokens()


@register("term_dictionary", f"{BASE}, {TS} SELECT * FROM ts")
def _(spark, sf):
    return corpus(spark, sf).term_stats()


@register("doc_vector", f"{BASE}, {TS} SELECT doc_id, term, tf AS freq, round(tf / doc_freq, 6) AS weight FROM dt JOIN ts USING (term)")
def _(spark, sf):
    c = corpus(spark, sf)
    return vectors.document_vectors(c, c.rows("DOCUMENT"), how=vectors.Aggregate("DF")).select("doc_id", "term", "freq", F.round("weight", 6).alias("weight"))


@register("postings", f"WITH {TOK} SELECT term, doc_id, pos FROM tok WHERE term IN ('orre', 'of')")
def _(spark, sf):
    return corpus(spark, sf).tokens().filter(F.col("term").isin("orre", "of")).select("term", "doc_id", "pos")


@register("typed_fields", "SELECT event_id, user_id, value, event_type, json_extract_string(props, '$.k') AS k, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts FROM events")
def _(spark, sf):
    return _events(spark, sf).values("EVENT", ["user_id", "value", "event_type", "ts", "props.k"]).withColumnRenamed("props.k", "k")


@register("zip_join", f"{FULL} SELECT doc_id, lang, n_chars, n_tokens FROM documents JOIN len USING (doc_id)")
def _(spark, sf):
    c = corpus(spark, sf)
    return c.zipped("DOCUMENT", c.lengths()).select("doc_id", "lang", "n_chars", "n_tokens")


@register("corpus_listing", "SELECT * FROM (VALUES ('conversations', 'conversations', '1'), ('documents', 'documents', '1')) v(id, name, version)")
def _(spark, sf):
    from .sources.corpus import Registry

    r = Registry()
    r.open_all({
        "documents": lambda: documents_corpus(spark, sf),
        "conversations": lambda: conversations_corpus(spark, sf),
        "missing": lambda: (_ for _ in ()).throw(FileNotFoundError("missing")),
    })
    return r.listing(spark).withColumn("name", F.element_at(F.split("name", "/"), -1))


@register("common_fields", "SELECT 'doc_id' AS field UNION ALL SELECT 'lang' UNION ALL SELECT 'source' UNION ALL SELECT 'text'")
def _(spark, sf):
    c = corpus(spark, sf)
    some = Corpus(spark, f"{sf}/some", [c.level(x) for x in ("DOCUMENT", "LINE", "SENTENCE")])
    return spark.createDataFrame([(x,) for x in some.common_fields()], "field string")


# ---------------------------------------------------------------- search


def _top(select: str, more: str = "") -> str:
    return f"{select} ORDER BY score DESC, doc_id LIMIT 20{more}"


BOTH = f"{tf('the')} a JOIN {tf('of', 'g')} b USING (doc_id)"


@register("search_tf_topk", f"{BASE} " + _top(f"SELECT doc_id, CAST(f + g AS DOUBLE) AS score FROM {BOTH}"))
def _(spark, sf):
    return search(corpus(spark, sf), "the of")


BM = "ln(1 + (n - d.df + 0.5) / (d.df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n_tokens / m))"


@register("search_bm25", f"""{FULL}, z AS (SELECT count(*) FILTER (n_tokens > 0) AS n, sum(n_tokens) / count(*) FILTER (n_tokens > 0) AS m FROM len),
p AS (SELECT doc_id, {BM} AS part FROM dt JOIN (SELECT term, count(*) AS df FROM dt GROUP BY 1) d USING (term) JOIN len USING (doc_id) CROSS JOIN z WHERE term IN ('orre', 'the'))
SELECT doc_id, round(sum(part), 6) AS score FROM p GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 50""")  # fmt: skip
def _(spark, sf):
    s = scored(corpus(spark, sf), "orre OR the", scoring="BM25").withColumn("score", F.round("score", 6))
    return s.orderBy(F.desc("score"), "doc_id").limit(50)


@register("search_none", f"{BASE} SELECT doc_id, CAST(count(DISTINCT term) AS DOUBLE) AS score FROM dt WHERE term IN ('orre', 'the', 'of') GROUP BY 1")
def _(spark, sf):
    return scored(corpus(spark, sf), "orre OR the OR of", scoring="NONE")


@register("search_sort_multi", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score, source, quality FROM {tf('the')} JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS FIRST, lower(source) ASC NULLS LAST, score DESC, doc_id LIMIT 40")
def _(spark, sf):
    return search(corpus(spark, sf), "the", fields=["source", "quality"], sort=[("quality", "D", False), ("source", "A", True), ("score", "D", False)], limit=40)


@register("search_score_band", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score FROM {tf('the')} WHERE f BETWEEN 5 AND 12")
def _(spark, sf):
    return scored(corpus(spark, sf), "the", min_score=5, max_score=12)


@register("search_matchall_tokens", f"{FULL} SELECT doc_id, CAST(n_tokens AS DOUBLE) AS score FROM len WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'of') AND doc_id NOT IN (SELECT doc_id FROM dt WHERE term = 'the')")
def _(spark, sf):
    return scored(corpus(spark, sf), "of^0 -the")


@register("search_totals", f"{BASE} SELECT count(*) AS total, CAST(sum(f) AS DOUBLE) AS total_score FROM {tf('the')}")
def _(spark, sf):
    return totals(scored(corpus(spark, sf), "the"))


@register("search_unlimited", f"{FULL} SELECT doc_id, CAST(n_tokens AS DOUBLE) AS score, lang FROM len JOIN documents USING (doc_id) ORDER BY score DESC, doc_id OFFSET 10")
def _(spark, sf):
    return search(corpus(spark, sf), "*", fields=["lang"], limit=-1, offset=10)


@register("search_late_fetch", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score, text, n_chars FROM {tf('orre')} JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 5")
def _(spark, sf):
    return search(corpus(spark, sf), "orre", fields=["text", "n_chars"], limit=10, offset=5)


@register("search_explain", f"{BASE} SELECT doc_id, CAST(coalesce(f, 0) + coalesce(g, 0) AS DOUBLE) AS score, concat_ws(' ', 'orre=' || f, 'of=' || g) AS explanation FROM {tf('orre')} a FULL JOIN {tf('of', 'g')} b USING (doc_id)")
def _(spark, sf):
    s = scored(corpus(spark, sf), "orre OR of", explain=True)
    return s.withColumn("explanation", F.array_join(F.transform("explanation", lambda x: F.concat(x["leaf"], F.lit("="), x["freq"].cast("string"))), " "))


@register("search_zero_boost", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score FROM {BOTH}")
def _(spark, sf):
    return scored(corpus(spark, sf), "the^3 of^0")


@register("hit_count_literal", f"{BASE}, {TS} SELECT total_term_freq AS hits FROM ts WHERE term = 'orre'")
def _(spark, sf):
    return hit_count(corpus(spark, sf), "orre", literal=True)


# ---------------------------------------------------------------- predicates


def _scored(name: str, query: str, sql: str, level: str = "DOCUMENT", **how) -> None:
    @register(name, sql)
    def _(spark, sf):
        return scored(corpus(spark, sf), query, level, **how)


_scored("pred_term", "orre", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score FROM {tf('orre')}")
_scored("pred_bool", "(orre OR of) the -and", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE term IN ('orre', 'of', 'the') AND doc_id IN (SELECT doc_id FROM dt WHERE term = 'the') AND doc_id IN (SELECT doc_id FROM dt WHERE term IN ('orre', 'of')) AND doc_id NOT IN (SELECT doc_id FROM dt WHERE term = 'and') GROUP BY 1")
_scored("pred_filter_plus", "+orre the", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score FROM {tf('the')} WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'orre')")
_scored("pred_phrase", '"of the"', f"WITH {TOK} SELECT a.doc_id, CAST(count(*) AS DOUBLE) AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
_scored("pred_slop_ordered", '"of the"~3', f"WITH {TOK} SELECT a.doc_id, CAST(count(DISTINCT a.pos) AS DOUBLE) AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.pos - a.pos - 1 <= 3 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
_scored("pred_slop_unordered", '"of the"~-3', f"WITH {TOK} SELECT a.doc_id, CAST(count(DISTINCT a.pos) AS DOUBLE) AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.pos <> b.pos AND abs(b.pos - a.pos) - 1 <= 2 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1")
_scored("pred_slop_three", '"the of and"~6', f"""WITH {TOK} SELECT doc_id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT a.doc_id, a.pos, min(c.pos) AS last FROM (SELECT x.doc_id, x.pos, min(y.pos) AS mid FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos <= x.pos + 8 WHERE x.term = 'the' AND y.term = 'of' GROUP BY ALL) a
JOIN tok c ON c.doc_id = a.doc_id AND c.pos > a.mid AND c.pos <= a.pos + 8 WHERE c.term = 'and' GROUP BY ALL) WHERE last - pos - 2 <= 6 GROUP BY 1""")
_scored("pred_complex_phrase", '"(of OR or*) the"', f"WITH {TOK} SELECT a.doc_id, CAST(count(*) AS DOUBLE) AS score FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE (a.term = 'of' OR a.term LIKE 'or%') AND b.term = 'the' GROUP BY 1")
_scored("pred_wildcard", "*rr?", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE term LIKE '%rr_' GROUP BY 1")
_scored("pred_exists", "quality:*", f"{BASE} SELECT doc_id, 1.0 :: DOUBLE AS score FROM labels WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)")
_scored("pred_fuzzy", "orre~1", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'orre') <= 1 GROUP BY 1")
_scored("pred_regex", "/or(re|th)+/", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE regexp_full_match(term, 'or(re|th)+') GROUP BY 1")
_scored("pred_numeric_range", "n_chars:{500 TO 900] quality:1 lang:en", "SELECT doc_id, 3.0 :: DOUBLE AS score FROM documents JOIN labels USING (doc_id) WHERE n_chars > 500 AND n_chars <= 900 AND quality = 1 AND lang = 'en'")
_scored("pred_term_range", "[or TO os}", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE term >= 'or' AND term < 'os' GROUP BY 1")
_scored("pred_string_exact", 'source:"src3" the', f"{BASE} SELECT doc_id, CAST(f + 1 AS DOUBLE) AS score FROM {tf('the')} JOIN documents USING (doc_id) WHERE source = 'src3'")


def _events(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(spark, f"{sf}/events", [Level("EVENT", ["event_id"], lambda: table(spark, sf, "events").withColumn("text", F.col("event_type")))])


@register("pred_date_range", "SELECT event_id, 1.0 :: DOUBLE AS score FROM events WHERE ts >= (SELECT TIMESTAMP '2024-01-05') AND ts < TIMESTAMP '2024-01-20'")
def _(spark, sf):
    return scored(_events(spark, sf), "ts:[2024-01-05 TO 2024-01-20}", "EVENT")


@register("pred_float_eq", "SELECT event_id, 1.0 :: DOUBLE AS score FROM events WHERE value = (SELECT min(value) FROM events WHERE event_id < 100)")
def _(spark, sf):
    least = table(spark, sf, "events").filter("event_id < 100").agg(F.min("value")).first()[0]
    return scored(_events(spark, sf), f"value:{least!r}", "EVENT")


@register("pred_default_level", f"WITH {STOK} SELECT doc_id, sent_no, CAST(count(*) AS DOUBLE) AS score FROM stok WHERE term = 'orre' GROUP BY ALL".replace("WITH stok", f"WITH {SENTS}, stok"))
def _(spark, sf):
    c = corpus(spark, sf)
    return scored(Corpus(spark, c.name, list(c.levels.values()), default_level="SENTENCE"), "orre")


@register("pred_double_range", "SELECT event_id, 2.0 :: DOUBLE AS score FROM events WHERE value > 10 AND value <= 60.5 AND user_id BETWEEN 5 AND 40")
def _(spark, sf):
    return scored(_events(spark, sf), "value:{10 TO 60.5] user_id:[5 TO 40]", "EVENT")


def _places(spark: SparkSession, sf: str) -> Corpus:
    at = F.struct((F.col("s_suppkey") * 37 % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 91 % 360 - 180).cast("double").alias("lon"))
    return Corpus(spark, f"{sf}/supplier", [Level("SUPPLIER", ["s_suppkey"], lambda: table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("text"), at.alias("at")))])


PLACES = "g AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 180 - 90 AS DOUBLE) AS lat, CAST(s_suppkey * 91 % 360 - 180 AS DOUBLE) AS lon FROM supplier)"
METRES = "2 * 6371008.7714 * asin(least(1.0, sqrt(pow(sin((radians({0}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({0})) * pow(sin((radians({1}) - radians(lon)) / 2), 2))))"


@register("geo_distance", f"WITH {PLACES} SELECT s_suppkey, 1.0 :: DOUBLE AS score FROM g WHERE {METRES.format(10.0, 20.0)} <= 5000000")
def _(spark, sf):
    return scored(_places(spark, sf), "at:10,20,5000000", "SUPPLIER")


@register("geo_box", f"WITH {PLACES} SELECT s_suppkey, 1.0 :: DOUBLE AS score FROM g WHERE lat BETWEEN -30 AND 40 AND (lon >= 100 OR lon <= -120)")
def _(spark, sf):
    return scored(_places(spark, sf), "at:-30,100,40,-120", "SUPPLIER")


@register("geo_polygon", f"""WITH {PLACES}, e AS (SELECT * FROM (VALUES (-40.0, -50.0, 45.0, -10.0), (45.0, -10.0, 10.0, 80.0), (10.0, 80.0, -40.0, -50.0)) v(a, b, c, d))
SELECT s_suppkey, 1.0 :: DOUBLE AS score FROM g WHERE (SELECT count(*) FROM e WHERE (a > lat) <> (c > lat) AND lon < b + (lat - a) / (c - a) * (d - b)) % 2 = 1""")
def _(spark, sf):
    return scored(_places(spark, sf), "at:-40,-50,45,-10,10,80", "SUPPLIER")


@register("geo_functions", f"WITH {PLACES} SELECT s_suppkey, round({METRES.format(60.0, 25.0)}, 3) AS metres FROM g")
def _(spark, sf):
    return _places(spark, sf).rows().select("s_suppkey", F.round(geo.distance(F.col("at.lat"), F.col("at.lon"), 60.0, 25.0), 3).alias("metres"))


LEXICON = [("orre", "en", "orre"), ("orre", "en", "orthe"), ("of", "en", "of"), ("of", "en", "ofth"), ("be", "en", "is"), ("be", "en", "was")]


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "lemma string, lang string, form string")


@register("pred_inflection", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE term IN ('is', 'was') GROUP BY 1")
def _(spark, sf):
    return scored(corpus(spark, sf), "text|infl_en:was", lexicon=_lexicon(spark))


@register("pred_inflection_affix", f"{BASE} SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM dt WHERE term IN ('thorre', 'thorthe', 'thofed', 'thorreed', 'thortheed') AND term LIKE '%ed' GROUP BY 1")
def _(spark, sf):
    return scored(corpus(spark, sf), "text|infl_en_th_ed:orre", lexicon=_lexicon(spark))


@register("pred_term_set", "SELECT doc_id, lang, source FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'fr' AND n_chars < 400)")
def _(spark, sf):
    rows = corpus(spark, sf).rows("DOCUMENT")
    return field_semi_join(rows, rows.filter("lang = 'fr' and n_chars < 400"), "source", ["doc_id"]).select("doc_id", "lang", "source")


@register("docset_ops", f"{BASE} SELECT doc_id FROM ((SELECT doc_id FROM dt WHERE term = 'the' INTERSECT SELECT doc_id FROM dt WHERE term = 'of') UNION SELECT doc_id FROM dt WHERE term = 'orre') EXCEPT SELECT doc_id FROM dt WHERE term = 'by'")
def _(spark, sf):
    return Compiler(corpus(spark, sf), "DOCUMENT").compile(q.parse("((the of) OR orre) NOT by")).hits.select("doc_id")


# ---------------------------------------------------------------- sub-queries

LDT = f"WITH {LINES}, {LTOK}, ldt AS (SELECT doc_id, line_no, term, count(*) AS tf FROM ltok GROUP BY ALL)"

_scored("sub_same_level", "<DOCUMENT§orre§DOCUMENT> the", f"{BASE} SELECT doc_id, CAST(f + g AS DOUBLE) AS score FROM {tf('orre')} a JOIN {tf('the', 'g')} b USING (doc_id)")
_scored("sub_fine_to_coarse", "<LINE§orre of§DOCUMENT>", f"{LDT} SELECT DISTINCT doc_id, 1.0 :: DOUBLE AS score FROM ldt a JOIN ldt b USING (doc_id, line_no) WHERE a.term = 'orre' AND b.term = 'of'")
_scored("sub_coarse_to_fine", "<DOCUMENT§orre lang:en§LINE> the", f"{LDT}, {TOK} SELECT doc_id, line_no, CAST(tf + 1 AS DOUBLE) AS score FROM ldt WHERE term = 'the' AND doc_id IN (SELECT doc_id FROM tok JOIN documents USING (doc_id) WHERE term = 'orre' AND lang = 'en')", "LINE")
_scored("sub_field", "<DOCUMENT§n_chars:[0 TO 120]§source> orre", f"{BASE} SELECT doc_id, CAST(f + 1 AS DOUBLE) AS score FROM {tf('orre')} JOIN documents USING (doc_id) WHERE source IN (SELECT source FROM documents WHERE n_chars <= 120)")
_scored("sub_anti", "the -<DOCUMENT§quality:1§DOCUMENT>", f"{BASE} SELECT doc_id, CAST(f AS DOUBLE) AS score FROM {tf('the')} WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
_scored("sub_nested", "<LINE§of <SENTENCE§orre§DOCUMENT>§DOCUMENT>", f"WITH {TOK}, {LINES}, {LTOK} SELECT DISTINCT doc_id, 1.0 :: DOUBLE AS score FROM ltok WHERE term = 'of' AND doc_id IN (SELECT doc_id FROM documents, (SELECT unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS s, doc_id AS i FROM documents) WHERE i = doc_id AND regexp_matches(s, '(?i)(^|\\s)[[:punct:]]*orre[[:punct:]]*(\\s|$)'))".replace("\\\\", "\\"))


@register("sub_multivalue", f"{BASE}, k AS (SELECT doc_id, term FROM dt WHERE tf >= 6) SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM k WHERE term IN (SELECT k.term FROM k JOIN documents USING (doc_id) WHERE source = 'src3' AND lang = 'fr'))")
def _(spark, sf):
    c = corpus(spark, sf)
    many = c.doc_terms().filter("tf >= 6").groupBy("doc_id").agg(F.collect_set("term").alias("keys"))
    rows = c.rows("DOCUMENT").join(many, "doc_id")
    return field_semi_join(rows, rows.filter("source = 'src3' and lang = 'fr'"), "keys", ["doc_id"]).select("doc_id")


@register("sub_coerced_keys", "SELECT c_custkey FROM customer WHERE CAST(c_nationkey AS BIGINT) IN (SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) FROM documents WHERE lang = 'fr')")
def _(spark, sf):
    numbers = corpus(spark, sf).rows("DOCUMENT").filter("lang = 'fr'").select(F.regexp_extract("source", "[0-9]+", 0).alias("number"))
    return field_semi_join(table(spark, sf, "customer"), numbers, "c_nationkey", ["c_custkey"], "number").select("c_custkey")


@register("sub_orders_lineitem", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def _(spark, sf):
    c = Corpus(spark, f"{sf}/orders", [
        Level("ORDER", ["o_orderkey"], lambda: table(spark, sf, "orders")),
        Level("ITEM", ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], lambda: table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")),
    ], default_level="ORDER")
    hits = Compiler(c, "ORDER").compile(q.parse("<ITEM§l_quantity:[49 TO *] l_returnflag:R§ORDER> o_orderdate:[1996-01-01 TO *]")).hits
    return c.rows("ORDER").join(hits, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


OFFSETS = "pts AS (SELECT user_id, CAST(event_id % 997 AS INT) AS off FROM events WHERE event_type = 'view'), dat AS (SELECT user_id, CAST(event_id % 997 AS INT) AS off, min(event_type || value) AS data FROM events WHERE event_type <> 'view' GROUP BY ALL)"


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events").withColumn("offset", (F.col("event_id") % 997).cast("int"))
    points = e.filter("event_type = 'view'").select("user_id", "offset")
    data = e.filter("event_type <> 'view'").groupBy("user_id", "offset").agg(F.min(F.concat("event_type", F.format_string("%09d", F.col("event_id")))).alias("data"))
    return points, data


OFFSETS = OFFSETS.replace("event_type || value", "event_type || lpad(CAST(event_id AS VARCHAR), 9, '0')")


@register("offset_asof", f"WITH {OFFSETS} SELECT user_id, off AS \"offset\", (SELECT d.data FROM dat d WHERE d.user_id = p.user_id AND d.off <= p.off ORDER BY d.off DESC LIMIT 1) AS data FROM pts p")
def _(spark, sf):
    return kwic.offset_data(*_points(spark, sf), ["user_id"], "PREV")


@register("offset_next", f"WITH {OFFSETS} SELECT user_id, off AS \"offset\", (SELECT d.data FROM dat d WHERE d.user_id = p.user_id AND d.off >= p.off ORDER BY d.off LIMIT 1) AS data FROM pts p")
def _(spark, sf):
    return kwic.offset_data(*_points(spark, sf), ["user_id"], "NEXT")


@register("offset_convert", f"WITH {OFFSETS} SELECT user_id, off AS \"offset\", upper(d.data) AS data FROM pts p LEFT JOIN dat d USING (user_id, off)")
def _(spark, sf):
    return kwic.offset_data(*_points(spark, sf), ["user_id"], "EXACT", tx.capitals)


@register("offset_list", f"WITH {OFFSETS} SELECT user_id, string_agg(off || ':' || data, ' ' ORDER BY off, data) AS entries FROM dat GROUP BY 1")
def _(spark, sf):
    return kwic.offset_list(_points(spark, sf)[1], ["user_id"]).select("user_id", F.array_join(F.transform("entries", lambda e: F.concat(e["offset"].cast("string"), F.lit(":"), e["data"])), " ").alias("entries"))


# ---------------------------------------------------------------- statistics

THE = f"{tf('the', 'score')} JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)"


@register("stats_global", f"{BASE} SELECT count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq, CAST(sum(n_chars) AS BIGINT) AS sum_n_chars, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS sum_quality FROM {THE}")
def _(spark, sf):
    return stats.query_stats(corpus(spark, sf), "the", sum_fields=["n_chars", "quality"])


@register("stats_grouped", f"{BASE} SELECT lang, quality, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq, CAST(sum(n_chars) AS BIGINT) AS sum_n_chars, string_agg(CAST(score AS VARCHAR), ',' ORDER BY score) AS term_freqs FROM {THE} GROUP BY 1, 2")
def _(spark, sf):
    return stats.grouped_stats(corpus(spark, sf), "the", ["lang", "quality"], sum_fields=["n_chars"], term_freqs=True).withColumn("term_freqs", F.array_join("term_freqs", ","))


@register("stats_prefix", f"{BASE} SELECT substr(source, 1, 4) AS source, substr(coalesce(CAST(toxic AS VARCHAR), ''), 1, 1) AS toxic, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {THE} GROUP BY 1, 2")
def _(spark, sf):
    return stats.grouped_stats(corpus(spark, sf), "the", ["source", "toxic"], [4, 1])


@register("stats_transform", f"{BASE} SELECT upper(lang) AS lang, CASE WHEN quality = 1 THEN 'good' ELSE 'other' END AS quality, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {THE} GROUP BY 1, 2")
def _(spark, sf):
    return stats.grouped_stats(corpus(spark, sf), "the", ["lang", "quality"], transform=lambda c: [tx.capitals(c[0]), F.when(c[1] == 1, "good").otherwise("other")])


@register("stats_grouper", f"{BASE} SELECT CAST(floor(n_chars / 1000) AS BIGINT) AS size, score > 5 AS often, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {THE} GROUP BY 1, 2")
def _(spark, sf):
    return stats.grouped_stats(corpus(spark, sf), "the", grouper=lambda d: {"size": F.floor(d["n_chars"] / 1000), "often": d["score"] > 5})


@register("stats_order", f"{BASE} SELECT lang, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {THE} GROUP BY 1 ORDER BY total_term_freq, doc_freq DESC LIMIT 3")
def _(spark, sf):
    return stats.grouped_stats(corpus(spark, sf), "the", ["lang"], sort=[("total_term_freq", "A", False)], limit=3)


@register("stats_head_sample", f"{BASE} SELECT lang, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM (SELECT * FROM {THE} ORDER BY doc_id LIMIT 100) GROUP BY 1")
def _(spark, sf):
    return stats.grouped_stats(corpus(spark, sf), "the", ["lang"], max_docs=100)


@register("stats_with_total", f"{BASE} SELECT lang, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq, grouping(lang) = 1 AS is_total FROM {THE} GROUP BY ROLLUP (lang)")
def _(spark, sf):
    return stats.with_total(corpus(spark, sf), "the", ["lang"])


SENT = f"WITH {SENTS}, {STOK}, sdt AS (SELECT doc_id, sent_no, term, count(*) AS tf FROM stok GROUP BY ALL)"
SHIT = "(SELECT text, tf AS score FROM sdt JOIN sents USING (doc_id, sent_no) WHERE term = 'orre')"


@register("stats_match", f"{SENT} SELECT text AS match, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {SHIT} GROUP BY 1")
def _(spark, sf):
    return stats.match_stats(corpus(spark, sf), "orre", "SENTENCE")


@register("stats_match_term", f"{SENT} SELECT substr(text, 1, 12) AS match, 'orre' AS term, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {SHIT} GROUP BY 1")
def _(spark, sf):
    return stats.match_stats(corpus(spark, sf), "orre", "SENTENCE", by_term=True, length=12)


@register("match_transform", f"{SENT} SELECT upper(trim(text)) AS match, count(*) AS doc_freq, CAST(sum(score) AS BIGINT) AS total_term_freq FROM {SHIT} GROUP BY 1")
def _(spark, sf):
    return stats.match_stats(corpus(spark, sf), "orre", "SENTENCE", transform=lambda c: tx.capitals(tx.trimmed(c)))


# ---------------------------------------------------------------- collocations

CTX = f"{FULL}, hit AS (SELECT doc_id FROM dt WHERE term = 'orre'), ctx AS (SELECT dt.* FROM dt WHERE doc_id IN (SELECT doc_id FROM hit)), su AS (SELECT term, CAST(sum(tf) AS BIGINT) AS freq FROM ctx GROUP BY 1)"
PMI = "ln(freq * ((SELECT count(*) FROM documents) / (SELECT count(*) FROM hit)) / doc_freq)"


def _colloc(name: str, weight: str, scaling: str, smoothing: float = 0.0) -> None:
    @register(name, f"{CTX} SELECT term, freq, round({weight}, 6) AS weight FROM su JOIN ts USING (term)")
    def _(spark, sf):
        v = vectors.term_vector(corpus(spark, sf), "orre", how=vectors.Aggregate(scaling, smoothing))
        return v.withColumn("weight", F.round("weight", 6))


_colloc("colloc_absolute", "CAST(freq AS DOUBLE)", "ABSOLUTE")
_colloc("colloc_df", "freq / doc_freq", "DF")
_colloc("colloc_ttf", "freq / total_term_freq", "TTF")
_colloc("colloc_df_smoothed", "freq / (doc_freq + 5)", "DF", 5)
_colloc("colloc_ttf_smoothed", "freq / (total_term_freq + 5)", "TTF", 5)
_colloc("colloc_pmi", PMI, "PMI")
_colloc("colloc_ppmi", f"greatest(0, {PMI})", "PPMI")


@register("colloc_flat", f"{CTX} SELECT term, count(*) AS freq, CAST(count(*) AS DOUBLE) AS weight FROM ctx GROUP BY 1")
def _(spark, sf):
    return vectors.term_vector(corpus(spark, sf), "orre", local_how=vectors.Local("FLAT"))


@register("colloc_min_scaling", f"{CTX} SELECT term, CAST(sum(least(tf, f)) AS BIGINT) AS freq, CAST(sum(least(tf, f)) AS DOUBLE) AS weight FROM ctx JOIN {tf('orre')} USING (doc_id) GROUP BY 1")
def _(spark, sf):
    return vectors.term_vector(corpus(spark, sf), "orre", local_how=vectors.Local("MIN"))


@register("colloc_filters", f"{CTX} SELECT term, CAST(sum(tf) AS BIGINT) AS freq, round(sum(tf) / max(doc_freq), 6) AS weight FROM ctx JOIN ts USING (term) WHERE tf >= 2 AND doc_freq BETWEEN 3 AND 500 AND length(term) >= 4 GROUP BY 1 HAVING sum(tf) BETWEEN 4 AND 400")
def _(spark, sf):
    v = vectors.term_vector(corpus(spark, sf), "orre", local_how=vectors.Local(min_freq_in_doc=2, min_doc_freq=3, max_doc_freq=500, min_term_length=4), how=vectors.Aggregate("DF", 0, 4, 400))
    return v.withColumn("weight", F.round("weight", 6))


GROUPED = f"{CTX}, gr AS (SELECT lang, term, CAST(sum(tf) AS BIGINT) AS freq FROM ctx JOIN documents USING (doc_id) GROUP BY ALL), gd AS (SELECT lang, count(DISTINCT doc_id) AS group_doc_freq, CAST(sum(tf) AS BIGINT) AS group_term_freq FROM ctx JOIN documents USING (doc_id) GROUP BY 1)"


@register("colloc_grouped", f"{GROUPED} SELECT lang, term, freq, CAST(freq AS DOUBLE) AS weight, group_doc_freq, group_term_freq FROM gr JOIN gd USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY freq DESC, term) <= 10")
def _(spark, sf):
    return vectors.grouped_vectors(corpus(spark, sf), "orre", ["lang"], limit=10)


@register("colloc_nested", f"{CTX}, top AS (SELECT term FROM su ORDER BY freq DESC, term LIMIT 5) SELECT a.term AS base, b.term, CAST(sum(b.tf) AS DOUBLE) AS weight FROM dt a JOIN dt b USING (doc_id) WHERE a.term IN (SELECT term FROM top) GROUP BY ALL")
def _(spark, sf):
    c = corpus(spark, sf)
    return vectors.nested_vectors(c, vectors.top_terms(vectors.term_vector(c, "orre"), 5))


@register("colloc_metadata", f"{CTX} SELECT (SELECT count(*) FROM hit) AS total_docs, (SELECT count(*) FROM hit) AS processed_docs, 1.0 :: DOUBLE AS sample_percentage, count(DISTINCT doc_id) AS contributing_docs, (SELECT count(*) FROM ctx) AS processed_terms, count(*) AS accepted_terms, CAST(sum(tf) AS BIGINT) AS total_accepted_term_freq FROM ctx WHERE tf >= 2")
def _(spark, sf):
    return vectors.vector_metadata(corpus(spark, sf), "orre", local_how=vectors.Local(min_freq_in_doc=2))


@register("colloc_sampled", f"""{BASE}, h AS (SELECT doc_id FROM dt WHERE term = 'the'), d AS (SELECT doc_id FROM h WHERE CAST('0x' || substr(sha256('7' || chr(31) || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 < 100.0 / (SELECT count(*) FROM h))
SELECT term, CAST(sum(tf) AS BIGINT) AS freq, CAST(sum(tf) AS DOUBLE) AS weight FROM dt WHERE doc_id IN (SELECT doc_id FROM d) GROUP BY 1""")
def _(spark, sf):
    return vectors.term_vector(corpus(spark, sf), "the", max_docs=100)


@register("context_terms", f"{CTX} SELECT DISTINCT term FROM ctx WHERE length(term) <= 6")
def _(spark, sf):
    return vectors.context_terms(corpus(spark, sf), "orre", local_how=vectors.Local(max_term_length=6))


@register("term_filter", f"{CTX} SELECT term, CAST(sum(tf) AS BIGINT) AS freq, CAST(sum(tf) AS DOUBLE) AS weight FROM ctx WHERE term LIKE 'th%' AND tf > 1 GROUP BY 1")
def _(spark, sf):
    return vectors.term_vector(corpus(spark, sf), "orre", local_how=vectors.Local(term_filter=lambda t, f: t.startswith("th") & (f > 1)))


@register("term_transform", f"{CTX} SELECT substr(term, 1, 3) AS term, CAST(sum(tf) AS BIGINT) AS freq, CAST(sum(tf) AS DOUBLE) AS weight FROM ctx GROUP BY 1")
def _(spark, sf):
    return vectors.term_vector(corpus(spark, sf), "orre", local_how=vectors.Local(term_transformer=lambda t: F.substring(t, 1, 3)))


@register("vec_topk", f"{CTX} SELECT term, freq, CAST(freq AS DOUBLE) AS weight FROM su ORDER BY freq DESC, term LIMIT 25")
def _(spark, sf):
    return vectors.top_terms(vectors.term_vector(corpus(spark, sf), "orre"), 25)


# ---------------------------------------------------------------- vectors and distances

VEC = f"{BASE}, x AS (SELECT term, CAST(sum(tf) AS DOUBLE) AS w FROM dt WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'orre') GROUP BY 1), y AS (SELECT term, CAST(sum(tf) AS DOUBLE) AS w FROM dt WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'edea') GROUP BY 1)"
_SIDES = {"BOTH": "JOIN", "EITHER": "FULL JOIN", "LEFT": "LEFT JOIN", "RIGHT": "RIGHT JOIN"}
_METRIC_SQL = {
    "COSINE": "1 - CASE WHEN sum(a * a) > 0 AND sum(b * b) > 0 THEN sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0 END",
    "JACCARD": "1 - sum(least(a, b)) / sum(greatest(a, b))",
    "DICE": "1 - 2 * sum(least(a, b)) / sum(a + b)",
    "EUCLIDEAN": "sqrt(sum((a - b) * (a - b)))",
    "MANHATTAN": "sqrt(sum(abs(a - b)))",
}


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(spark, sf)
    return tuple(vectors.term_vector(c, t).select("term", "weight") for t in ("orre", "edea"))


def _distance(metric: str, filtering: str) -> None:
    name = f"dist_{'euclid' if metric == 'EUCLIDEAN' else metric.lower()}_{filtering.lower()}"

    @register(name, f"{VEC}, z AS (SELECT coalesce(x.w, 0) AS a, coalesce(y.w, 0) AS b FROM x {_SIDES[filtering]} y USING (term)) SELECT round({_METRIC_SQL[metric]}, 6) AS {metric.lower()} FROM z")
    def _(spark, sf):
        return dist.distances(*_two(spark, sf), (metric,), filtering).select(F.round(metric.lower(), 6).alias(metric.lower()))


for _m in ("COSINE", "EUCLIDEAN", "MANHATTAN"):
    for _f in _SIDES:
        _distance(_m, _f)
for _m in ("JACCARD", "DICE"):
    _distance(_m, "EITHER")

NORM = f"{VEC}, xn AS (SELECT term, w / sqrt(sum(w * w) OVER ()) AS w FROM x), yn AS (SELECT term, w / sqrt(sum(w * w) OVER ()) AS w FROM y)"


@register("vec_normalize", f"{NORM} SELECT term, round(w, 9) AS weight FROM xn")
def _(spark, sf):
    return dist.normalize(_two(spark, sf)[0].withColumn("k", F.lit(1)), ["k"]).select("term", F.round("weight", 9).alias("weight"))


@register("vec_center", f"{VEC} SELECT term, round(w - avg(w) OVER (), 9) AS weight FROM x")
def _(spark, sf):
    return dist.center(_two(spark, sf)[0].withColumn("k", F.lit(1)), ["k"]).select("term", F.round("weight", 9).alias("weight"))


@register("dist_centernorm", f"{NORM}, z AS (SELECT coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b FROM (SELECT term, w - avg(w) OVER () AS w FROM xn) a FULL JOIN (SELECT term, w - avg(w) OVER () AS w FROM yn) b USING (term)) SELECT 1 AS k, round({_METRIC_SQL['COSINE']}, 6) AS cosine FROM z")
def _(spark, sf):
    a, b = (v.withColumn("k", F.lit(1)) for v in _two(spark, sf))
    return dist.distances(a, b, ("COSINE",), normalization="CENTERNORM", keys=("k",)).select("k", F.round("cosine", 6).alias("cosine"))


@register("vec_join", f"{VEC} SELECT term, coalesce(x.w, 0) AS x, coalesce(y.w, 0) AS y FROM x FULL JOIN y USING (term)")
def _(spark, sf):
    return dist.joined(*_two(spark, sf), [], []).select("term", "x", "y")


EMB = "e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS term, CAST(unnest(embedding) AS DOUBLE) AS w FROM embeddings), lab AS (SELECT label, term, avg(w) + 10 AS w FROM e JOIN embeddings USING (vec_id) GROUP BY ALL)"


def _label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("term", "w"))
    return e.groupBy("label", F.col("term").cast("string").alias("term")).agg((F.avg(F.col("w").cast("double")) + 10).alias("weight"))


@register("pairwise_distance", f"WITH {EMB} SELECT a.label AS left, b.label AS right, round(sqrt(sum((a.w - b.w) * (a.w - b.w))), 6) AS distance FROM lab a JOIN lab b USING (term) WHERE a.label < b.label GROUP BY ALL".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def _(spark, sf):
    return dist.pairwise(_label_vectors(spark, sf), "label", "EUCLIDEAN").withColumn("distance", F.round("distance", 6))


GV = f"""{BASE}, a AS (SELECT lang, term, sum(tf) AS w FROM dt JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'orre') GROUP BY ALL),
b AS (SELECT lang, term, sum(tf) AS w FROM dt JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'of') GROUP BY ALL),
an AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang)) AS w FROM a), bn AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY lang)) AS w FROM b),
da AS (SELECT lang, count(DISTINCT doc_id) AS df1, CAST(sum(tf) AS BIGINT) AS tf1 FROM dt JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'orre') GROUP BY 1),
db AS (SELECT lang, count(DISTINCT doc_id) AS df2, CAST(sum(tf) AS BIGINT) AS tf2 FROM dt JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'of') GROUP BY 1)"""


def _grouped_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = corpus(spark, sf)
    return vectors.grouped_vectors(c, "orre", ["lang"]), vectors.grouped_vectors(c, "of", ["lang"])


@register("vector_diff", f"""{GV}, z AS (SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b FROM a FULL JOIN b ON a.lang = b.lang AND a.term = b.term)
SELECT lang, CASE WHEN df1 IS NOT NULL AND df2 IS NOT NULL THEN d END AS distance, coalesce(df1, 0) AS df1, coalesce(df2, 0) AS df2, coalesce(tf1, 0) AS tf1, coalesce(tf2, 0) AS tf2 FROM (SELECT lang, round({_METRIC_SQL['COSINE']}, 6) AS d FROM z GROUP BY 1) LEFT JOIN da USING (lang) LEFT JOIN db USING (lang)""")
def _(spark, sf):
    return vectors.vector_diff(*_grouped_pair(spark, sf), ["lang"]).withColumn("distance", F.round("distance", 6))


_D = "SELECT lang, '{0}' AS list, r AS rank, term, d AS difference FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {1}, term) AS r FROM z) WHERE r <= 5"


@register("diff_lists", f"""{GV}, z AS (SELECT coalesce(an.lang, bn.lang) AS lang, coalesce(an.term, bn.term) AS term, round(coalesce(an.w, 0) - coalesce(bn.w, 0), 9) AS d FROM an FULL JOIN bn ON an.lang = bn.lang AND an.term = bn.term WHERE coalesce(an.lang, bn.lang) IN (SELECT lang FROM a INTERSECT SELECT lang FROM b))
{' UNION ALL '.join(_D.format(n, o) for n, o in (('different', 'abs(d) DESC'), ('first', 'd DESC'), ('second', 'd'), ('similar', 'abs(d)')))}""")
def _(spark, sf):
    return vectors.diff_lists(*_grouped_pair(spark, sf), ["lang"], 5)


@register("group_key_union", f"{GV} SELECT lang FROM a UNION SELECT lang FROM b")
def _(spark, sf):
    return vectors.vector_diff(*_grouped_pair(spark, sf), ["lang"]).select("lang")


@register("similar_collocations", f"""{CTX}, one AS (SELECT term, CAST(freq AS DOUBLE) AS y FROM su ORDER BY freq DESC, term LIMIT 20),
hold AS (SELECT DISTINCT doc_id FROM dt WHERE term IN (SELECT term FROM one)), two AS (SELECT DISTINCT dt.term FROM dt WHERE doc_id IN (SELECT doc_id FROM hold)),
three AS (SELECT a.term AS base, b.term, CAST(sum(b.tf) AS DOUBLE) AS x FROM dt a JOIN dt b USING (doc_id) WHERE a.term IN (SELECT term FROM two) GROUP BY ALL),
s AS (SELECT base, sum(x) AS s, sum(x * x) AS ss FROM three GROUP BY 1), m AS (SELECT base, sum(x * y) AS xy, sum(least(x, y)) AS low, sum(abs(x - y) - x - y) AS off FROM three JOIN one USING (term) GROUP BY 1),
t AS (SELECT sum(y) AS t, sum(y * y) AS tt FROM one), r AS (SELECT two.term, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss, coalesce(xy, 0) AS xy, coalesce(low, 0) AS low, coalesce(off, 0) AS off, t, tt FROM two LEFT JOIN s ON s.base = two.term LEFT JOIN m ON m.base = two.term CROSS JOIN t),
d AS (SELECT term, unnest(['cosine', 'dice', 'jaccard', 'euclidean', 'manhattan']) AS metric, unnest([1 - xy / (sqrt(ss) * sqrt(tt)), 1 - 2 * low / (s + t), 1 - low / (s + t - low), sqrt(ss + tt - 2 * xy), sqrt(s + t + off)]) AS v FROM r WHERE s > 0)
SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY round(v, 9), term) AS rank, term, round(v, 6) AS distance FROM d QUALIFY rank <= 20""")
def _(spark, sf):
    found = vectors.similar_collocations(corpus(spark, sf), "orre")
    return found.withColumn("distance", F.round("distance", 6))


@register("search_distance", f"{CTX}, v AS (SELECT term, CAST(freq AS DOUBLE) AS y FROM su), n AS (SELECT sqrt(sum(y * y)) AS n FROM v) SELECT doc_id, round(1 - sum(tf * coalesce(y, 0)) / (sqrt(sum(tf * tf)) * max(n)), 6) AS distance FROM dt LEFT JOIN v USING (term) CROSS JOIN n WHERE doc_id IN (SELECT doc_id FROM dt WHERE term = 'of') GROUP BY 1")
def _(spark, sf):
    c = corpus(spark, sf)
    return vectors.search_distance(c, "of", vectors.term_vector(c, "orre")).withColumn("distance", F.round("distance", 6))


# ---------------------------------------------------------------- similar terms


def _similar_terms(name: str, pattern: str, where: str) -> None:
    @register(name, f"{BASE}, {TS} SELECT term, doc_freq AS total_doc_freq, total_term_freq FROM ts WHERE {where}")
    def _(spark, sf):
        return similar.all_similar_terms(corpus(spark, sf), pattern)


_similar_terms("similar_terms_fuzzy", "there~2", "damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'there') <= 2")
_similar_terms("similar_terms_wildcard", "th?r*", "term LIKE 'th_r%'")
_similar_terms("similar_terms_regex", "/(an)+d?/", "regexp_full_match(term, '(an)+d?')")
_similar_terms("fuzzy_extended", "there~2:3:false", "levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'there') <= 2 AND substr(term, 1, 3) = 'the'")
NGRAM = f"WITH {TOK}, g AS (SELECT a.doc_id, a.term || ' ' || b.term AS term FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term LIKE 'o%' AND b.term LIKE 'th_'), r AS (SELECT term, count(DISTINCT doc_id) AS total_doc_freq, count(*) AS total_term_freq FROM g GROUP BY 1)"


@register("similar_terms_ngram", f"{NGRAM} SELECT * FROM r")
def _(spark, sf):
    return similar.all_similar_terms(corpus(spark, sf), "o* th?")


@register("similar_terms_page", f"{NGRAM} SELECT * FROM r ORDER BY total_term_freq DESC, term LIMIT 7 OFFSET 3")
def _(spark, sf):
    return similar.similar_terms(corpus(spark, sf), "o* th?", sort="TTF", limit=7, offset=3)


@register("similar_terms_general", f"{NGRAM} SELECT count(*) AS terms, CAST(sum(total_doc_freq) AS BIGINT) AS total_doc_freq, CAST(sum(total_term_freq) AS BIGINT) AS total_term_freq FROM r")
def _(spark, sf):
    return similar.general(similar.all_similar_terms(corpus(spark, sf), "o* th?"))


@register("term_union", f"{BASE} SELECT DISTINCT term FROM dt WHERE term LIKE 'or%' OR damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'the') <= 1")
def _(spark, sf):
    c = Compiler(corpus(spark, sf), "DOCUMENT")
    return c.expansion(q.leaf(None, "or*")).union(c.expansion(q.leaf(None, "the~1"))).distinct()


# ---------------------------------------------------------------- concordances and units

SRANK = "sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY pos) AS n FROM stok)"
KW = f"WITH {SENTS}, {STOK}, {SRANK}, k AS (SELECT m.doc_id, m.sent_no, m.pos, m.term AS terms, coalesce(a.term, '') AS sort_0, coalesce(b.term, '') AS sort_1, s.text AS snippet, s.lang FROM sr m LEFT JOIN sr a ON a.doc_id = m.doc_id AND a.sent_no = m.sent_no AND a.n = m.n + 1 LEFT JOIN sr b ON b.doc_id = m.doc_id AND b.sent_no = m.sent_no AND b.n = m.n - 1 JOIN sents s ON s.doc_id = m.doc_id AND s.sent_no = m.sent_no WHERE m.term = 'orre')"


@register("kwic_sorted", f"{KW} SELECT doc_id, sent_no, terms, sort_0, sort_1, snippet, lang FROM k")
def _(spark, sf):
    rows = kwic.kwic(corpus(spark, sf), "orre", "SENTENCE", ["1AI", "-1DS"], fields=["lang"], limit=-1)
    return rows.drop("start", "end", "match")


@register("kwic_page", f"{KW} SELECT doc_id, sent_no, terms, sort_0, sort_1, snippet FROM k ORDER BY lower(sort_0), sort_1 DESC, doc_id, sent_no, pos LIMIT 10 OFFSET 20")
def _(spark, sf):
    return kwic.kwic(corpus(spark, sf), "orre", "SENTENCE", ["1AI", "-1DS"], limit=10, offset=20).drop("start", "end", "match")


SPLACE = r"""p0 AS (SELECT doc_id, a, g, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?:\S*-\s+)*\S+') AS a, regexp_split_to_array(text, '(?:\S*-\s+)*\S+') AS g FROM documents)),
p1 AS (SELECT doc_id, i - 1 AS pos, a[i] AS t, length(a[i]) AS n, length(g[i]) AS gap FROM p0),
pl AS (SELECT doc_id, pos, lower(regexp_replace(regexp_replace(t, '-\s+', '', 'g'), '^[[:punct:]]*(.*?)[[:punct:]]*$', '\1', 's')) AS term, CAST(coalesce(sum(n + gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS INT) AS start, n FROM p1)"""


@register("places", f"WITH {SPLACE} SELECT doc_id, pos, term, start, CAST(start + n AS INT) AS \"end\" FROM pl WHERE term <> ''")
def _(spark, sf):
    return corpus(spark, sf).places()


@register("span_match", f"WITH {SPLACE} SELECT doc_id, pos, pos + 1 AS last_pos, start, CAST(lead(start) OVER w + lead(n) OVER w AS INT) AS \"end\", 'of the' AS terms FROM pl WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY term = 'of' AND lead(term) OVER w = 'the'")
def _(spark, sf):
    return kwic.matches(corpus(spark, sf), '"of the"')


@register("span_match_words", f"WITH {SPLACE}, h AS (SELECT a.doc_id, a.pos FROM pl a JOIN pl b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the') SELECT DISTINCT p.doc_id, p.pos, p.pos AS last_pos, p.start, CAST(p.start + p.n AS INT) AS \"end\", p.term AS terms FROM h JOIN pl p ON p.doc_id = h.doc_id AND p.pos IN (h.pos, h.pos + 1)")
def _(spark, sf):
    return kwic.matches(corpus(spark, sf), '"of the"', full_spans=False)


@register("render_match", f"WITH {SPLACE} SELECT doc_id, pos, substr(text, 1, start) || '<b>' || substr(text, start + 1, n) || '</b>' || substr(text, CAST(start + n + 1 AS INT)) AS marked FROM pl JOIN documents USING (doc_id) WHERE term = 'orre'")
def _(spark, sf):
    c = corpus(spark, sf)
    rows = kwic.texts(c, kwic.matches(c, "orre"))
    return rows.select("doc_id", "pos", kwic.marked(F.col("text"), F.col("start"), F.col("end")).alias("marked"))


@register("passages_per_match", f"WITH {SPLACE} SELECT doc_id, start, CAST(start + n AS INT) AS \"end\", 1 AS n_matches FROM pl WHERE term = 'orre'")
def _(spark, sf):
    own = kwic.passages(corpus(spark, sf), "orre", join_matches=False)
    at = F.expr("start + instr(snippet, '<b>') - 1")
    return own.select("doc_id", at.alias("start"), (at + F.expr("instr(snippet, '</b>') - instr(snippet, '<b>') - 3")).alias("end"), "n_matches")


@register("snippets")
def _(spark, sf):
    return kwic.passages(corpus(spark, sf), "orre of")


@register("passages_best")
def _(spark, sf):
    return kwic.passages(corpus(spark, sf), "the of", most=2)


@register("context_expand", f"WITH {SENTS} SELECT doc_id, sent_no AS seg, text, string_agg(text, '|') OVER (PARTITION BY doc_id ORDER BY sent_no ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS context FROM sents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return tx.expand(tx.segments(docs, ["doc_id"], "SENTENCE"), ["doc_id"], 1, 2, "|")


@register("unit_expand", f"WITH {LINES} SELECT doc_id, line_no AS seg, text, string_agg(text, '|') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 0 FOLLOWING) AS context FROM lines")
def _(spark, sf):
    return tx.expand(tx.segments(table(spark, sf, "documents"), ["doc_id"], "LINE"), ["doc_id"], 2, 0, "|")


@register("unit_line", f"WITH {LINES} SELECT doc_id, line_no AS seg, text FROM lines")
def _(spark, sf):
    return tx.segments(table(spark, sf, "documents"), ["doc_id"], "LINE")


@register("unit_sentence", f"WITH {SENTS} SELECT doc_id, sent_no AS seg, text FROM sents")
def _(spark, sf):
    return tx.segments(table(spark, sf, "documents"), ["doc_id"], "SENTENCE")


@register("unit_paragraph", "SELECT doc_id, generate_subscripts(a, 1) - 1 AS seg, unnest(a) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\n+') AS a FROM documents)".replace("\\\\", "\\"))
def _(spark, sf):
    return tx.segments(table(spark, sf, "documents"), ["doc_id"], "PARAGRAPH")


@register("unit_document", "SELECT doc_id, 0 AS seg, text FROM documents")
def _(spark, sf):
    return tx.segments(table(spark, sf, "documents"), ["doc_id"], "DOCUMENT")


@register("unit_char", "SELECT doc_id, generate_subscripts(a, 1) - 1 AS seg, unnest(a) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '') AS a FROM documents)")
def _(spark, sf):
    return tx.segments(table(spark, sf, "documents"), ["doc_id"], "CHARACTER")


_WORDS = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"


def _unit_sql(pattern: str) -> str:
    """Places of all matches of a pattern."""
    quoted = pattern.replace("'", "''")
    return f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS a, regexp_split_to_array(text, '{quoted}') AS g FROM documents),
q AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS t, unnest(g[1:len(a)]) AS gap FROM p)
SELECT doc_id, CAST(i - 1 AS INT) AS seg, CAST(sum(length(t) + length(gap)) OVER w - length(t) AS INT) AS start, CAST(sum(length(t) + length(gap)) OVER w AS INT) AS "end" FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


@register("unit_word", _unit_sql(_WORDS))
def _(spark, sf):
    return tx.unit_rows(table(spark, sf, "documents"), "WORD")


@register("unit_token", _unit_sql(_WORDS + "|(?s:.)"))
def _(spark, sf):
    return tx.unit_rows(table(spark, sf, "documents"), "TOKEN")


@register("turns_in_conversation", f"WITH {tok_sql('ct', 'conv_id, turn', 'conversations')} SELECT DISTINCT conv_id, 1.0 :: DOUBLE AS score FROM ct a WHERE term = 'the' AND EXISTS (SELECT 1 FROM ct b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.term = 'of')")
def _(spark, sf):
    return scored(conversations_corpus(spark, sf), "<TURN§the of§CONVERSATION>", "CONVERSATION")


@register("custom_analyzer", "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY ALL")
def _(spark, sf):
    c = Corpus(spark, f"{sf}/documents-analyzed", [Level("DOCUMENT", ["doc_id"], lambda: table(spark, sf, "documents"))], analyzers={"text": lambda c: F.split(F.lower(c), " ")})
    return c.doc_terms()


# ---------------------------------------------------------------- information


@register("info_terms", f"{FULL} SELECT (SELECT count(*) FROM len WHERE n_tokens > 0) AS total_docs, count(*) AS total_terms, CAST(sum(doc_freq) AS BIGINT) AS sum_doc_freq, CAST(sum(total_term_freq) AS BIGINT) AS sum_total_term_freq FROM ts")
def _(spark, sf):
    return info.term_info(corpus(spark, sf))


@register("info_term_listing", f"{BASE}, {TS} SELECT * FROM ts WHERE (SELECT count(*) FROM ts) <= 10000000 ORDER BY doc_freq DESC, term")
def _(spark, sf):
    return info.term_listing(corpus(spark, sf), most=10_000_000, sort="DOCFREQ", direction="DESC")


@register("info_points", "SELECT 'n_chars' AS field, count(n_chars) AS total_docs, count(n_chars) AS total_values, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max FROM documents UNION ALL SELECT 'quality', count(quality), count(quality), CAST(min(quality) AS DOUBLE), CAST(max(quality) AS DOUBLE) FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return info.point_info(corpus(spark, sf).rows("DOCUMENT"), ["n_chars", "quality"])


@register("info_quantiles", "SELECT CAST(p AS DOUBLE) AS p, round(v, 6) AS value FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS p, unnest(quantile_cont(CAST(n_chars AS DOUBLE), [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])) AS v FROM documents)")
def _(spark, sf):
    return info.quantiles(corpus(spark, sf).rows("DOCUMENT"), "n_chars", [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1], exact=True).withColumn("value", F.round("value", 6))


HISTO = "s AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v), b AS (SELECT least(floor((v - lo) / ((hi - lo) / 8)), 7) AS bin, count(*) AS c FROM v, s GROUP BY 1) SELECT CAST(i AS INT) AS bin, round(lo + i * (hi - lo) / 8, 6) AS low, round(lo + (i + 1) * (hi - lo) / 8, 6) AS high, coalesce(c, 0) AS n, round(coalesce(c, 0) / s.n, 9) AS proportion FROM range(8) r(i) CROSS JOIN s LEFT JOIN b ON b.bin = i"


@register("info_histogram", f"WITH v AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents), {HISTO}")
def _(spark, sf):
    return _rounded_histogram(info.histogram(corpus(spark, sf).rows("DOCUMENT"), "n_chars", 8))


def _rounded_histogram(h: DataFrame) -> DataFrame:
    return h.withColumns({"low": F.round("low", 6), "high": F.round("high", 6), "proportion": F.round("proportion", 9)})


@register("digest_missing_as_zero", f"WITH v AS (SELECT CAST(coalesce(quality, 0) AS DOUBLE) AS v FROM documents LEFT JOIN labels USING (doc_id)), {HISTO}")
def _(spark, sf):
    return _rounded_histogram(derived(spark, (sf, "stats", "quality"), lambda: info.histogram(corpus(spark, sf).rows("DOCUMENT"), "quality", 8)))


@register("info_digest_terms", f"{BASE}, {TS}, c AS (SELECT doc_freq AS value, count(*) AS n FROM ts GROUP BY 1) SELECT value, n, CAST(coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM c")
def _(spark, sf):
    return info.cumulative(corpus(spark, sf).term_stats(), "doc_freq")


@register("index_info", f"WITH {LINES}, {SENTS} SELECT 'SOURCE' AS level, 0 AS level_order, count(DISTINCT source) AS n_docs FROM documents UNION ALL SELECT 'DOCUMENT', 1, count(*) FROM documents UNION ALL SELECT 'LINE', 2, count(*) FROM lines UNION ALL SELECT 'SENTENCE', 3, count(*) FROM sents")
def _(spark, sf):
    return info.level_info(corpus(spark, sf))


# ---------------------------------------------------------------- maps


@register("mds_classical")
def _(spark, sf):
    return reduce.reduced(_label_vectors(spark, sf), "label", "CMDS", 2, "EUCLIDEAN")


@register("mds_stress")
def _(spark, sf):
    return reduce.reduced(_label_vectors(spark, sf), "label", "SMDS", 2, "EUCLIDEAN")


@register("tsne")
def _(spark, sf):
    return reduce.reduced(_label_vectors(spark, sf), "label", "TSNE", 2, "EUCLIDEAN")


@register("search_mds")
def _(spark, sf):
    c = corpus(spark, sf)
    top = search(c, "orre", limit=15)
    return reduce.reduced(c.doc_terms().join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi").select("doc_id", "term", F.col("tf").cast("double").alias("weight")), "doc_id", "SMDS")


# ---------------------------------------------------------------- results and functions


@register("sink_json", f"{BASE} SELECT '{{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"tf\":' || f || '}}' AS json FROM {tf('orre')} JOIN documents USING (doc_id)")
def _(spark, sf):
    c = corpus(spark, sf)
    rows = c.rows("DOCUMENT").join(scored(c, "orre"), "doc_id").select("doc_id", "lang", F.col("score").cast("long").alias("tf"))
    return sinks.as_json(rows)


@register("sink_csv", f"{BASE} SELECT f || ',' || lang || ',' || source AS line FROM {tf('orre')} JOIN documents USING (doc_id)")
def _(spark, sf):
    c = corpus(spark, sf)
    return sinks.as_csv(c.rows("DOCUMENT").join(scored(c, "orre"), "doc_id").select("score", "lang", "source"))


@register("sink_csv_grouped", f"{BASE} SELECT lang || ',' || quality || ',' || count(*) || ',' || CAST(sum(score) AS BIGINT) AS line FROM {THE} WHERE quality IS NOT NULL GROUP BY lang, quality")
def _(spark, sf):
    return sinks.as_csv(stats.grouped_stats(corpus(spark, sf), "the quality:[0 TO 1]^0", ["lang", "quality"]))


@register("cached_result", f"{BASE} SELECT lang, count(*) AS doc_freq, CAST(sum(f) AS BIGINT) AS total_term_freq FROM {tf('of')} JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, sf):
    c = corpus(spark, sf)
    key = sinks.call_id("queryStats", c.name, c.version, {"query": "of", "field": ["lang"]})
    return sinks.ResultCache(spark).get(key, lambda: stats.grouped_stats(c, "of", ["lang"]))


@register("cache_key", "SELECT doc_id, sha256(lang || ':' || source || ':' || doc_id) AS key FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws(":", "lang", "source", F.col("doc_id").cast("string")), 256).alias("key"))


@register("string_functions", f"{BASE}, {TS} SELECT term, length(term) AS n, substr(term, 1, 2) AS head, lower(term) AS low, term || '? ' || term AS gram FROM ts")
def _(spark, sf):
    return corpus(spark, sf).term_stats().select("term", F.length("term").alias("n"), F.substring("term", 1, 2).alias("head"), F.lower("term").alias("low"), F.concat("term", F.lit("? "), "term").alias("gram"))


@register("date_parse", "SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) AS ms, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate >= '1995-03-01' AND o_orderdate < '1996-07-15'")
def _(spark, sf):
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    inside = (at >= Compiler.value("1995-03", "LONGPOINT")) & (at < Compiler.value("1996-07-15", "LONGPOINT"))
    return table(spark, sf, "orders").filter(inside).select("o_orderkey", at.alias("ms"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@register("map_build", f"{BASE} SELECT doc_id, string_agg(term || '=' || tf, ',' ORDER BY term) AS entries FROM dt GROUP BY 1")
def _(spark, sf):
    m = corpus(spark, sf).doc_terms().groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("m"))
    return m.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("entries"))


@register("fuzzy_distance", f"{BASE}, {TS} SELECT term FROM ts WHERE damerau_levenshtein(regexp_replace(term, '[^ -~]', '#', 'g'), 'thier') <= 1")
def _(spark, sf):
    return corpus(spark, sf).term_stats().filter(within_edits(F.col("term"), "thier", 1)).select("term")


@register("term_drift", "WITH t AS (SELECT ts, event_type || ' ' || CAST(user_id AS VARCHAR) AS text FROM events) SELECT date_trunc('day', ts) AS window_start, term, count(*) AS tf FROM (SELECT ts, unnest(string_split(text, ' ')) AS term FROM t) GROUP BY ALL")
def _(spark, sf):
    return term_drift(table(spark, sf, "events").select("ts", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text")))
