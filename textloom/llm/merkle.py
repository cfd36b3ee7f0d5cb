"""Document fingerprints: Merkle trees over paragraphs and sections.

Leaves are paragraphs (lines that aren't blank), inner nodes sections, the root the document. A section ends at a blank line
and after a paragraph whose hash begins with ``0``, so long runs of paragraphs have sections too, and an edit moves no other
section's bounds. A hash is the first 32 hex digits of SHA-256 over a letter for the level and the text or the children's
hashes. Equal roots are equal trees; where roots differ, sections that the other document lacks are searched for edits and
no others.

A document is compared with its base: the least doc_id among those that share its longest paragraph (of equally long ones
that with the least hash). ``compare`` does so for any pairs. ``partners`` looks for the base through all paragraphs: the
earlier document that shares most of them, and null where no earlier one shares any.

Defined results: a null text has a null tree and no base; a text without paragraphs is a root without sections, and all
such texts have one base; texts are hashed whole; rows that repeat a doc_id are rows each, and of a base's rows the one
with the least root counts; a null doc_id is nobody's base; an empty table gives an empty result; other columns take no
part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

BLANK = " \t\r\f\v"
TREE = "doc_id long, root string, sections array<string>, section_ends array<int>, paragraphs array<string>, longest string"


def _hash(letter: bytes, data: bytes) -> str:
    return hashlib.sha256(letter + data).hexdigest()[:32]


def tree(text: str) -> tuple[str, list[str], list[int], list[str], str]:
    """Root, section hashes, the number of paragraphs up to each section's end, paragraph hashes, longest paragraph's hash."""
    sections: list[str] = []
    ends: list[int] = []
    leaves: list[str] = []
    begin, best = 0, (0, "")

    def close() -> None:
        nonlocal begin
        if len(leaves) > begin:
            sections.append(_hash(b"s", "".join(leaves[begin:]).encode()))
            ends.append(len(leaves))
            begin = len(leaves)

    for line in text.split("\n"):
        if not line.strip(BLANK):
            close()
            continue
        leaf = _hash(b"p", line.encode("utf-8", "surrogatepass"))
        leaves.append(leaf)
        if len(line) > best[0] or (len(line) == best[0] and leaf < best[1]):
            best = (len(line), leaf)
        if leaf[0] == "0":
            close()
    close()
    return _hash(b"r", "".join(sections).encode()), sections, ends, leaves, best[1]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [tree(t) if t is not None else (None,) * 5 for t in batch.column("text").to_pylist()]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "root", "sections", "section_ends", "paragraphs", "longest"])


def trees(docs: DataFrame) -> DataFrame:
    """The tree of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_trees, TREE)


def _absent(mine: Column, theirs: Column) -> Column:
    """Places in ``mine`` of hashes that ``theirs`` lacks."""
    lacking = F.array_except(mine, theirs)
    return F.filter(F.sequence(F.lit(0), F.size(mine) - 1), lambda i: F.array_contains(lacking, F.get(mine, i)))


def _edits(sections: str, ends: str, paragraphs: str, other_sections: str, other_paragraphs: str) -> tuple[Column, Column]:
    """Places of the differing sections, and of the paragraphs in them that the other document lacks."""
    some = F.size(paragraphs) > 0
    changed = F.when(some, _absent(F.col(sections), F.col(other_sections)))
    # paragraphs of equal sections are never looked at
    inside = F.flatten(F.transform(changed, lambda s: F.sequence(F.when(s == 0, 0).otherwise(F.get(F.col(ends), s - 1)), F.get(F.col(ends), s) - 1)))
    mine = F.transform(inside, lambda i: F.get(F.col(paragraphs), i))
    lacking = F.array_except(mine, F.col(other_paragraphs))
    return changed, F.filter(inside, lambda i: F.array_contains(lacking, F.get(F.col(paragraphs), i)))


def compare(pairs: DataFrame) -> DataFrame:
    """``pairs``: a tree's columns and those of another with ``base_`` before their names. Adds ``equal``,
    ``changed_sections``, ``changed_paragraphs`` (places in the tree) and ``removed_paragraphs`` (places in the base)."""
    empty = F.expr("cast(array() as array<int>)")
    equal = F.col("root") == F.col("base_root")
    sections, paragraphs = _edits("sections", "section_ends", "paragraphs", "base_sections", "base_paragraphs")
    _, removed = _edits("base_sections", "base_section_ends", "base_paragraphs", "sections", "paragraphs")
    known = F.col("base_root").isNotNull() & F.col("root").isNotNull()
    unless_equal = lambda c: F.when(known, F.when(equal, empty).otherwise(F.coalesce(c, empty)))
    return pairs.withColumns({"equal": equal, "changed_sections": unless_equal(sections), "changed_paragraphs": unless_equal(paragraphs), "removed_paragraphs": unless_equal(removed)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, root, n_sections, n_paragraphs, base_id, equal, changed_sections, changed_paragraphs, removed_paragraphs``."""
    all_trees = settle(trees(docs), "trees")
    named = all_trees.filter("doc_id is not null and root is not null")
    firsts = named.groupBy("longest").agg(F.min(F.struct("doc_id", "root")).alias("first"))
    firsts = firsts.select("longest", F.col("first.doc_id").alias("base_id"), F.col("first.root").alias("first_root"))
    own = ["root", "sections", "section_ends", "paragraphs"]
    bases = named.select(F.col("doc_id").alias("base_id"), F.col("root").alias("first_root"), F.col("longest"), *[F.col(c).alias(f"base_{c}") for c in own])
    bases = firsts.join(bases, ["base_id", "first_root", "longest"]).dropDuplicates(["longest"]).drop("first_root")
    found = compare(all_trees.join(bases, "longest", "left"))
    return found.select("doc_id", "root", F.size("sections").alias("n_sections"), F.size("paragraphs").alias("n_paragraphs"), "base_id", "equal", "changed_sections", "changed_paragraphs", "removed_paragraphs")


def most_shared(named: DataFrame) -> DataFrame:
    """``root, base_id, base_root, shared`` of each tree that an earlier and different one shares paragraphs with: that which
    shares most different ones, of those the least doc_id. Trees count once, by their least doc_id."""
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("id"), F.first("paragraphs").alias("paragraphs"))
    leaves = settle(firsts.select("id", "root", F.explode(F.array_distinct("paragraphs")).alias("leaf")), "leaves")
    # paragraphs of the very same trees are joined as one of their number
    of = F.xxhash64("root")
    places = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor(of).alias("x"), F.sum(of.cast("decimal(38,0)")).alias("y")).filter("n > 1")
    same = places.groupBy("n", "x", "y").agg(F.min("leaf").alias("leaf"), F.count("*").alias("weight")).select("leaf", "weight")
    held = settle(leaves.join(same, "leaf"), "shared_leaves")
    other = held.select("leaf", F.col("id").alias("base_id"), F.col("root").alias("base_root"))
    pairs = held.join(other, "leaf").filter("base_id < id").groupBy("root", "base_id", "base_root").agg(F.sum("weight").alias("shared"))
    best = pairs.groupBy("root").agg(F.min(F.struct((-F.col("shared")).alias("less"), "base_id", "base_root")).alias("best"))
    return best.select("root", "best.base_id", "best.base_root", (-F.col("best.less")).alias("shared"))


def partners(docs: DataFrame) -> DataFrame:
    """``doc_id, root, base_id, shared, equal, changed_sections, changed_paragraphs, removed_paragraphs``: each document beside the
    earlier one that shares most different paragraphs with it (``shared`` of them), an equal one before others; nulls where
    there is none. A row with a null doc_id is compared with an equal document only."""
    all_trees = settle(trees(docs), "trees")
    named = all_trees.filter("doc_id is not null and root is not null")
    first = named.groupBy("root").agg(F.min("doc_id").alias("first_id"), F.first(F.size(F.array_distinct("paragraphs"))).cast("long").alias("own"))
    found = first.join(most_shared(named).withColumnRenamed("base_id", "found_id").withColumnRenamed("base_root", "found_root"), "root", "left")
    # a null doc_id comes after all others
    copy = F.col("first_id").isNotNull() & F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(True))
    rows = all_trees.join(found, "root", "left").withColumn("copy", copy)
    for name, if_copy, otherwise in (("base_id", "first_id", "found_id"), ("their_root", "root", "found_root"), ("shared", "own", "shared")):
        rows = rows.withColumn(name, F.when(F.col("copy"), F.col(if_copy)).otherwise(F.col(otherwise)))
    own = ["root", "sections", "section_ends", "paragraphs"]
    bases = named.dropDuplicates(["root"]).select(F.col("root").alias("their_root"), *[F.col(c).alias(f"base_{c}") for c in own])
    return compare(rows.join(bases, "their_root", "left")).select("doc_id", "root", "base_id", "shared", "equal", "changed_sections", "changed_paragraphs", "removed_paragraphs")
