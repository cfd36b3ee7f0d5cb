"""A corpus: text at several levels of granularity, its fields, and the tables derived from it."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions
from .store import derived, state

STORED = "NUMERICDOCVALUES FLOATDOCVALUES DOUBLEDOCVALUES SORTEDDOCVALUES SORTEDNUMERICDOCVALUES SORTEDSETDOCVALUES SINGULARSTOREDFIELD MULTIPLESTOREDFIELDS TERMVECTOR LATLONDOCVALUES NONE".split()
INDEXED = "TEXT STRING INTPOINT LONGPOINT FLOATPOINT DOUBLEPOINT LATLONPOINT NONE".split()
_BY_TYPE = {"int": ("NUMERICDOCVALUES", "INTPOINT"), "bigint": ("NUMERICDOCVALUES", "LONGPOINT"), "float": ("FLOATDOCVALUES", "FLOATPOINT"), "double": ("DOUBLEDOCVALUES", "DOUBLEPOINT"), "string": ("SORTEDDOCVALUES", "STRING"), "timestamp": ("NUMERICDOCVALUES", "LONGPOINT"), "timestamp_ntz": ("NUMERICDOCVALUES", "LONGPOINT"), "array<string>": ("SORTEDSETDOCVALUES", "STRING"), "array<bigint>": ("SORTEDNUMERICDOCVALUES", "LONGPOINT"), "struct<lat:double,lon:double>": ("LATLONDOCVALUES", "LATLONPOINT")}


@dataclass(frozen=True)
class FieldInfo:
    id: str
    description: str = ""
    stored_as: str = "NONE"
    indexed_as: str = "NONE"
    contains_json: bool = False

    def __post_init__(self):
        if self.stored_as not in STORED or self.indexed_as not in INDEXED:
            raise ValueError(f"field {self.id}: unknown type {self.stored_as} or {self.indexed_as}")


@dataclass
class Level:
    """A granularity: its key columns (those of coarser levels first, as far as it has them) and its rows."""

    id: str
    keys: list[str]
    frame: Callable[[], DataFrame]
    description: str = ""
    fields: dict[str, FieldInfo] = field(default_factory=dict)
    #: Keys and content alone, where that takes less than ``frame``.
    texts: Callable[[], DataFrame] | None = None
    #: Rows whose keys are unique if, and only if, those of the level are, where that takes less than ``texts``, and their keys.
    identity: tuple[Callable[[], DataFrame], list[str]] | None = None

    def text_rows(self, content: str) -> DataFrame:
        return (self.texts or self.frame)().select(*self.keys, content)

    def unique(self) -> bool:
        """Whether no two rows have the same keys."""
        frame, keys = self.identity or (self.texts or self.frame, self.keys)
        return not frame().groupBy(*keys).count().filter("count > 1").head(1)


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan over all cores where it has fewer parts than these; a larger one is as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class Corpus:
    """Levels in order from coarse to fine. Every row of a level carries the keys of the coarser ones."""

    def __init__(self, spark: SparkSession, name: str, levels: list[Level], content: str = "text", default_level: str | None = None, version: str = "1", analyzers: dict[str, Callable[[Column], Column]] | None = None, paths: tuple[str, ...] = ()):
        self.spark, self.name, self.content, self.version = spark, name, content, version
        self.levels = {x.id: x for x in levels}
        self.order = {x.id: k for k, x in enumerate(levels)}
        self.default_level = default_level or levels[-1].id
        self.analyzers = analyzers or {}
        #: The tables' files: when they change, derived tables are built again.
        self.of = state(spark, *paths)

    def level(self, level: str | None = None) -> Level:
        try:
            return self.levels[level or self.default_level]
        except KeyError:
            raise ValueError(f"no level {level} in {list(self.levels)}") from None

    def rows(self, level: str | None = None) -> DataFrame:
        return self.level(level).frame()

    def keys(self, level: str | None = None) -> list[str]:
        return self.level(level).keys

    def field(self, level: str, name: str) -> FieldInfo:
        """What is known of a field; an undeclared one is taken by its column's type."""
        own = self.level(level)
        if name in own.fields:
            return own.fields[name]
        kinds = dict(own.frame().dtypes)
        if name == self.content:
            return FieldInfo(name, stored_as="SINGULARSTOREDFIELD", indexed_as="TEXT")
        if name not in kinds:
            raise ValueError(f"no field {name} at level {level}")
        return FieldInfo(name, "", *_BY_TYPE.get(kinds[name], ("SINGULARSTOREDFIELD", "NONE")))

    def fields(self, level: str) -> dict[str, FieldInfo]:
        return {c: self.field(level, c) for c in self.rows(level).columns}

    def common_fields(self) -> list[str]:
        """Fields that all levels have."""
        return sorted(reduce(set.intersection, (set(self.rows(x).columns) for x in self.levels)))

    def values(self, level: str, names: list[str]) -> DataFrame:
        """The level's keys and fields; ``name.path`` is a value inside a JSON field, times are milliseconds."""
        rows = self.rows(level)
        kinds, out = dict(rows.dtypes), []
        for name in names:
            head, _, path = name.partition(".")
            if name not in kinds and path:
                out.append(F.get_json_object(head, f"$.{path}").alias(name))
            else:
                out.append(F.unix_millis(F.col(name).cast("timestamp")).alias(name) if kinds[name].startswith(("timestamp", "date")) else F.col(name))
        return rows.select(*self.keys(level), *out)

    # derived tables

    def _derived(self, kind: str, level: str, build: Callable[[], DataFrame]) -> DataFrame:
        return derived(self.spark, (self.name, kind, level), build, self.of)

    def tokens(self, level: str | None = None) -> DataFrame:
        """``keys, pos, term``."""
        own = self.level(level)

        def build() -> DataFrame:
            if analyzer := self.analyzers.get(self.content):
                rows = own.text_rows(self.content).select(*own.keys, F.posexplode(analyzer(F.col(self.content))).alias("pos", "term"))
                return rows.filter("term <> ''")
            return text_functions.tokens(own.text_rows(self.content), own.keys, self.content)

        return self._derived("tokens", own.id, build)

    def places(self, level: str | None = None) -> DataFrame:
        """``keys, pos, term, start, end``. An analyzer's terms are where they next occur in the text, their case aside; those that
        don't occur so (stems, say) have no place."""
        own = self.level(level)

        def build() -> DataFrame:
            if analyzer := self.analyzers.get(self.content):
                return text_functions.analyzed_places(own.text_rows(self.content), own.keys, self.content, analyzer)
            return text_functions.tokens_with_places(own.text_rows(self.content), own.keys, self.content)

        return self._derived("places", own.id, build)

    def placed(self, level: str, hits: DataFrame, only: list[str] | None = None) -> DataFrame:
        """``places`` in the rows whose keys ``hits`` has (as ``store.small`` gives them), of the terms ``only`` alone, if given: made
        from these rows' text, so that a query for few rows needs no places of all."""
        own = self.level(level)
        hits = hits.select(*own.keys)
        if self.content in self.analyzers:
            rows = self.places(own.id).join(hits, own.keys, "left_semi")
            return rows if only is None else rows.filter(F.col("term").isin(only))
        return text_functions.tokens_with_places(own.text_rows(self.content).join(hits, own.keys, "left_semi"), own.keys, self.content, only)

    def doc_terms(self, level: str | None = None) -> DataFrame:
        """``keys, term, tf``: files are runs sorted by term, so a term's filter skips pages and row groups. A text's terms are counted
        where it is read; only rows that share their keys have to meet for that."""
        own = self.level(level)

        def build() -> DataFrame:
            if self.content in self.analyzers:
                return self.tokens(own.id).groupBy(*own.keys, "term").agg(F.count("*").alias("tf")).sortWithinPartitions("term")
            counts = text_functions.term_counts(own.text_rows(self.content), own.keys, self.content)
            return counts if own.unique() else counts.groupBy(*own.keys, "term").agg(F.sum("tf").alias("tf")).sortWithinPartitions("term")

        return self._derived("doc_terms", own.id, build)

    def term_stats(self, level: str | None = None) -> DataFrame:
        """``term, doc_freq, total_term_freq``."""
        own = self.level(level)
        return self._derived("term_stats", own.id, lambda: self.doc_terms(own.id).groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_term_freq")))

    def term_ids(self, level: str | None = None) -> DataFrame:
        """``term, term_id``: a number for each term, drawn once as the table is written; for joins of many term pairs."""
        own = self.level(level)
        return self._derived("term_ids", own.id, lambda: self.term_stats(own.id).select("term", F.monotonically_increasing_id().alias("term_id")))

    def lengths(self, level: str | None = None) -> DataFrame:
        """``keys, n_tokens`` of every row; 0 without terms."""
        own = self.level(level)

        def build() -> DataFrame:
            n = self.doc_terms(own.id).groupBy(*own.keys).agg(F.sum("tf").alias("n_tokens"))
            return own.frame().select(*own.keys).join(n, own.keys, "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))

        return self._derived("lengths", own.id, build)

    def zipped(self, level: str, other: DataFrame) -> DataFrame:
        """The level's rows with the columns of another table that has one row for each."""
        return self.rows(level).join(other, self.keys(level))


class Registry:
    """Corpora by name; those that fail to open are left out with a warning."""

    def __init__(self):
        self.corpora: dict[str, Corpus] = {}
        self.warnings: dict[str, str] = {}

    def open(self, name: str, opener: Callable[[], Corpus]) -> None:
        try:
            self.corpora[name] = opener()
        except Exception as x:  # noqa: BLE001 - one broken corpus must not hide the others
            self.warnings[name] = str(x)

    def open_all(self, openers: dict[str, Callable[[], Corpus]]) -> None:
        """Several corpora at one time."""
        with ThreadPoolExecutor() as pool:
            list(pool.map(lambda x: self.open(*x), openers.items()))

    def __getitem__(self, name: str) -> Corpus:
        return self.corpora[name]

    def listing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, c.name, c.version) for k, c in sorted(self.corpora.items())], "id string, name string, version string")


def read_metadata(path_or_text: str) -> dict:
    """A corpus's description: its levels with their fields, over which the common fields are laid; defaults filled in."""
    raw = json.loads(path_or_text) if path_or_text.lstrip().startswith("{") else json.load(open(path_or_text))
    one = lambda k, f: FieldInfo(k, f.get("description", ""), f.get("storedAs", "NONE"), f.get("indexedAs", "NONE"), f.get("containsJson", False))
    common = {k: one(k, f) for k, f in raw.get("commonFields", {}).items()}
    levels = [
        {"id": x["id"], "description": x.get("description", ""), "term": x["term"], "indices": x.get("indices") or [x.get("index", x["id"])], "preload": x.get("preload", False), "indexType": x.get("indexType", ""), "offsetDataConverter": x.get("offsetDataConverter", ""), "fields": {k: one(k, f) for k, f in x.get("fields", {}).items()} | common}
        for x in raw["levels"]
    ]
    return {
        "name": raw["name"], "version": raw["version"], "contentField": raw["contentField"], "contentTokensField": raw["contentTokensField"],
        "defaultLevel": raw.get("defaultLevel", levels[-1]["id"]), "levels": levels, "indexingAnalyzers": raw.get("indexingAnalyzers", {}), "auths": raw.get("auths", {}), "offsetDataConverter": raw.get("offsetDataConverter", ""),
    }


def open_corpus(spark: SparkSession, path: str, metadata: str) -> Corpus:
    """A corpus from its description and a folder with a Parquet table for each index of each level."""
    raw = read_metadata(metadata)
    levels, keys = [], []
    for x in raw["levels"]:
        keys = [*keys, x["term"]]

        def frame(x=x, keys=tuple(keys)) -> DataFrame:
            tables = [spark.read.parquet(f"{path}/{i}") for i in x["indices"]]
            out = reduce(lambda a, b: a.join(b, [k for k in keys if k in a.columns and k in b.columns]), tables)
            return out.persist() if x["preload"] else out

        levels.append(Level(x["id"], list(keys), frame, x["description"], x["fields"]))
    return Corpus(spark, raw["name"], levels, raw["contentField"], raw["defaultLevel"], raw["version"], paths=tuple(f"{path}/{i}" for x in raw["levels"] for i in x["indices"]))


def documents_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """SOURCE > DOCUMENT > LINE and SENTENCE over the ``documents`` table, with labels as fields."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def documents() -> DataFrame:
        return docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")

    def split(unit: str, number: str, *fields: str) -> Callable[[], DataFrame]:
        return lambda: text_functions.segments(spread(docs.select("doc_id", "text", *fields)), ["doc_id", *fields], unit).withColumnRenamed("seg", number)

    ids = lambda: docs.select("doc_id"), ["doc_id"]

    return Corpus(spark, f"{sf_dir}/documents", [
        Level("SOURCE", ["source"], lambda: docs.groupBy("source").agg(F.count("*").alias("n_docs"))),
        Level("DOCUMENT", ["doc_id"], documents, texts=lambda: spread(docs.select("doc_id", "text")), identity=ids),
        Level("LINE", ["doc_id", "line_no"], split("LINE", "line_no", "source", "lang"), texts=split("LINE", "line_no"), identity=ids),
        Level("SENTENCE", ["doc_id", "sent_no"], split("SENTENCE", "sent_no", "source", "lang"), texts=split("SENTENCE", "sent_no"), identity=ids),
    ], default_level="DOCUMENT", paths=(f"{sf_dir}/documents.parquet",))


def conversations_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """CONVERSATION > TURN."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    whole = lambda: turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_turns"))
    return Corpus(spark, f"{sf_dir}/conversations", [Level("CONVERSATION", ["conv_id"], whole), Level("TURN", ["conv_id", "turn"], lambda: turns)], default_level="TURN", paths=(f"{sf_dir}/conversations.parquet",))


def describe(corpus: Corpus) -> dict:
    """A corpus as a JSON-like value, without any job."""
    return {"name": corpus.name, "version": corpus.version, "default_level": corpus.default_level, "common_fields": corpus.common_fields(), "levels": [{"id": x.id, "keys": x.keys, "description": x.description, "fields": {k: asdict(f) for k, f in corpus.fields(x.id).items()}} for x in corpus.levels.values()]}
