"""Licences, archives, fingerprints, language model: against brute force, held-out text and odd rows."""

import gzip
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import arc, licences, lm, merkle
from textloom.llm.common import settle, words

# ---------------------------------------------------------------- licences

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def found(text):
    return licences.match_rules(licences.Known(licences.SENTENCES).find(text), licences.RULES)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, [("mit-name",), ("sentence",), ("mit-full",)]),
        (APACHE, [("apache-header",)]),
        ("Some prose.\nLicensed under CC BY-NC 4.0.", [("cc-by-nc",)]),
        ("A heading\nReleased under the MIT License.\nMore.", [("mit-name",)]),
        ("This work is licensed under the GNU General Public License, version 3.", [("gpl-name",)]),
        ("SPDX-License-Identifier: Apache-2.0", [("spdx-apache",)]),
        ("x. All rights reserved.", [("all-rights",)]),
        ("This licence is mine. Permission is hereby refused.", []),
        ("", []),
    ],
)
def test_licences(text, want):
    assert [(r,) for _, r, *_ in found(text)] == want
    for _, _, begin, end, _ in found(text):
        assert 0 <= begin < end <= len(text)


def brute_find(known, text):
    """All runs of pieces from each place, the longest known one, without any shortcut."""
    bounds = [(m.start(), m.end(), m.group() != "\n") for m in licences._BOUND.finditer(text)] + [(len(text), len(text), True)]
    pieces, at = [], 0
    for start, end, stop in bounds:
        pieces.append((at, start, stop))
        at = end
    out, k = [], 0
    while k < len(pieces):
        best = 0
        for j in range(k, len(pieces)):
            if licences.normalise(text[pieces[k][0] : pieces[k][1]]) and (name := known.lookup(licences.normalise(" ".join(text[a:b] for a, b, _ in pieces[k : j + 1])))):
                best, hit = j - k + 1, (name, pieces[j][1])
            if pieces[j][2]:
                break
        if best:
            out.append(hit)
        k += best or 1
    return out


def test_licences_against_brute_force(spark, data):
    known = licences.Known(licences.SENTENCES)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(-1, MIT), (-2, "x\n" * 50 + APACHE + "\n" + MIT)]
    for _, text in rows:
        assert [(n, e) for n, _, e in known.find(text)] == brute_find(known, text)
    got = licences.scan(spark.read.parquet(f"{data}/documents.parquet")).count()
    assert got == sum(len(found(t)) for i, t in rows if i >= 0) > 0


def test_rules_take_in_order():
    r = [licences.Rule("long", "A", ("a", "b")), licences.Rule("short", "B", ("a",))]
    hits = [("a", 0, 1), ("b", 2, 3), ("a", 4, 5), ("c", 6, 7)]
    assert [m[1] for m in licences.match_rules(hits, tuple(r))] == ["long", "short", "sentence"]


def test_licences_odd_rows(frame, odd):
    rows = [*odd, (70, MIT), (70, MIT), (71, "word " * 200_000 + "\nReleased under the MIT License.")]
    got = licences.scan(frame(rows)).collect()
    assert sorted(r.doc_id for r in got) == [70] * 6 + [71]
    assert licences.scan(frame([])).count() == 0


# ---------------------------------------------------------------- archives


def archive(version, records):
    if version == 1:
        body = b"1 0 Example\nURL IP-address Archive-date Content-type Archive-length\n"
        head = f"filedesc://test.arc 0.0.0.0 20010203040506 text/plain {len(body)}\n".encode()
    else:
        body = b"2 0 Example\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
        head = f"filedesc://test.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 test.arc {len(body)}\n".encode()
    out = [head + body]
    for url, date, mime, block in records:
        fields = [url, "192.0.2.7", date, mime] + (["200", "-", "-", "0", "test.arc"] if version == 2 else [])
        out.append(b"\n" + " ".join([*fields, str(len(block))]).encode() + b"\n" + block)
    return out


RECORDS = [
    ("http://a.example/x y", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one\n\ntwo</p>"),
    ("dns:a.example", "20010203040507", "text/dns", b"20010203040507\na.example. 60 IN A 192.0.2.7"),
    ("http://a.example/empty", "2001", "text/plain", b""),
    ("http://a.example/odd", "20010203040509", "image/png", b"\x89PNG\r\n\r\n\x00"),
]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_archives(spark, tmp_path, version, packed):
    parts = archive(version, RECORDS)
    data = b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)
    (tmp_path / "test.arc").write_bytes(data)
    rows = sorted(arc.read_archives(spark, str(tmp_path)).collect(), key=lambda r: r.number)
    assert [r.warc_type for r in rows] == ["warcinfo", "response", "response", "resource", "resource"]
    assert [r.target_uri for r in rows[1:]] == [r[0] for r in RECORDS]
    assert [r.version for r in rows] == [version] * 5 and len({r.record_id for r in rows}) == 5
    assert rows[3].warc_date == "2001-01-01T00:00:00Z" and rows[1].warc_date == "2001-02-03T04:05:06Z"
    for r, (_, _, _, block) in zip(rows[1:], RECORDS):
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == block + b"\r\n\r\n" and f"Content-Length: {len(block)}".encode() in head
        assert r.block_digest == "sha256:" + hashlib.sha256(block).hexdigest()
    assert rows[1].payload_digest == "sha256:" + hashlib.sha256(b"<p>one\n\ntwo</p>").hexdigest()


def test_broken_archives():
    data = b"".join(archive(1, RECORDS[:2]))
    cut = list(arc.parse_archive(data[:-5]))
    assert len(cut) == 3 and arc.to_warc("a", 2, cut[2][1], cut[2][2])["truncated"] and b"WARC-Truncated: length" in arc.to_warc("a", 2, cut[2][1], cut[2][2])["record"]
    noise = data.replace(b"\ndns:", b"\nnot a header line\ndns:")
    assert [h.url for _, h, _ in arc.parse_archive(noise)][1:] == [r[0] for r in RECORDS[:2]]
    assert list(arc.parse_archive(b"")) == []


def test_pages(spark):
    rows = [(1, "http://a/ b", "<p>é</p>"), (1, "http://a/ b", "<p>é</p>"), (2, None, None), (None, "", ""), (300, "http://c", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, number string")
    out = arc.convert(arc.page_records(pages)).collect()
    assert len(out) == 5 and sorted(str(r.id) for r in out) == ["1", "1", "2", "300", "None"]
    one = next(r for r in out if r.id == 1)
    assert one.target_uri == "http://a/%20b" and one.payload_digest == "sha256:" + hashlib.sha256("<p>é</p>".encode()).hexdigest()
    assert next(r for r in out if r.id == 2).target_uri == "unknown:" and {r.version for r in out} == {1, 2}
    assert arc.convert(arc.page_records(pages.limit(0))).count() == 0


# ---------------------------------------------------------------- fingerprints


def brute_tree(text):
    sections, own = [], []
    for line in text.split("\n"):
        if not line.strip(" \t\r\f\v"):
            sections.append(own)
            own = []
            continue
        own = [*own, hashlib.sha256(b"p" + line.encode()).hexdigest()[:32]]
        if own[-1].startswith("0"):
            sections.append(own)
            own = []
    sections = [s for s in [*sections, own] if s]
    hashes = [hashlib.sha256(b"s" + "".join(s).encode()).hexdigest()[:32] for s in sections]
    return hashlib.sha256(b"r" + "".join(hashes).encode()).hexdigest()[:32], hashes, sections


TEXT = "\n\n".join("\n".join(f"paragraph {s} {k} with words" for k in range(30)) for s in range(5))


@pytest.mark.parametrize(
    ("digits", "want"),
    [("20011399256199", "2001-01-01T00:00:00Z"), ("20010230010203", "2001-02-01T00:00:00Z"), ("20000229235959", "2000-02-29T23:59:59Z"), ("20010203046001", "2001-02-03T04:00:00Z"), ("2001", "2001-01-01T00:00:00Z"), ("20011", "2001-01-01T00:00:00Z"), ("0000", "0001-01-01T00:00:00Z")],
)
def test_arc_dates_are_of_the_calendar(digits, want):
    assert arc.warc_date(digits) == want


def test_arc_rows_without_a_header_are_told(spark):
    members = [(1, b"http://a/ 192.0.2.1 20010203040506 text/plain 2\nok"), (2, b"no header\nx"), (None, b"")]
    rows = spark.createDataFrame([(i, "x.arc", 0, 1, bytearray(m), "extra") for i, m in members], "id long, archive string, number long, version int, member binary, line string")
    assert [r.id for r in arc.convert(rows).collect()] == [1]
    assert {(r.id, r.line) for r in arc.unread(rows).collect()} == {(2, "no header"), (None, "")}
    assert arc.unread(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\n\n", "a", "a\nb\n\nc", TEXT, "x" * 100_000, "é\r\n \t\nü"])
def test_trees(text):
    root, hashes, ends, leaves, _ = merkle.tree(text)
    want_root, want, sections = brute_tree(text)
    assert (root, hashes) == (want_root, want) and leaves == [p for s in sections for p in s]
    assert ends == list(np.cumsum([len(s) for s in sections]))


def test_edits_are_located(spark):
    lines = TEXT.split("\n")
    edited = list(lines)
    edited[40] = "another paragraph"
    moved = lines[:10] + ["inserted"] + lines[10:]
    docs = spark.createDataFrame([(1, TEXT), (2, "\n".join(edited)), (3, "\n".join(moved)), (4, TEXT)], "doc_id long, text string")
    t = merkle.trees(docs)
    base = t.filter("doc_id = 1").select(*[F.col(c).alias(f"base_{c}") for c in t.columns])
    got = {r.doc_id: r for r in merkle.compare(t.crossJoin(base)).collect()}
    place = [k for k, x in enumerate(x for x in edited if x) if x == "another paragraph"]
    assert got[1].equal and got[4].equal and got[4].changed_paragraphs == []
    assert not got[2].equal and got[2].changed_paragraphs == place == got[2].removed_paragraphs and len(got[2].changed_sections) <= 2
    assert got[3].changed_paragraphs == [10] and got[3].removed_paragraphs == []


def test_fingerprints_odd_rows(frame, odd):
    got = merkle.fingerprints(frame(odd)).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].root is None and by[1][0].base_id is None
    assert by[2][0].base_id == 2 == by[3][0].base_id and by[2][0].equal and by[2][0].n_paragraphs == 0
    assert by[7][0].base_id == 6 and by[7][0].equal and len(by[8]) == 2
    assert merkle.fingerprints(frame([])).count() == 0


def test_partners_through_all_paragraphs(frame, odd):
    a, b, c, longest = "one line here", "a second line", "the third of lines", "by far the longest paragraph of this text"
    rows = [(1, "\n".join([a, b, c, longest])), (2, "\n".join([a, b, c, longest + " edited"])), (3, "\n".join([a, "other", c + " and more, so that it is the longest one"])), (4, "alone"), (5, "\n".join([a, b, c, longest])), (6, None), (None, a), (7, "alone, edited")]
    got = {r.doc_id: r for r in merkle.partners(frame(rows)).collect()}
    assert len(got) == len(rows)
    assert {k: (r.base_id, r.shared, r.equal) for k, r in got.items() if k} == {1: (None, None, None), 2: (1, 3, False), 3: (1, 1, False), 4: (None, None, None), 5: (1, 4, True), 6: (None, None, None), 7: (None, None, None)}
    assert got[2].changed_paragraphs == [3] == got[2].removed_paragraphs and got[4].changed_sections is None
    assert merkle.partners(frame(odd)).count() == len(odd) and merkle.partners(frame([])).count() == 0


def test_partners_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    trees = {r.doc_id: merkle.tree(r.text) for r in docs.collect() if r.text is not None}
    want = {}
    for x, t in trees.items():
        ranked = [(-len(set(t[3]) & set(o[3])), o[0] != t[0], y) for y, o in trees.items() if y < x and (o[0] == t[0] or set(t[3]) & set(o[3]))]
        want[x] = (min(ranked)[2], -min(ranked)[0]) if ranked else (None, None)
    assert {r.doc_id: (r.base_id, r.shared) for r in merkle.partners(docs).collect() if r.doc_id in trees} == want


# ---------------------------------------------------------------- language model


def small_units(spark, texts, v):
    return settle(lm.units(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), v), "units")


def test_units_of_words(spark):
    texts = ["a a a b b c", "a b unknown Words here"]
    v = lm.vocabulary(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own=2)
    hashes = words(["a b c"])[0]
    own = lm.Lookup(v)(hashes)
    assert list(own[:2]) == [v.units[list(v.hashes).index(h)] for h in hashes[:2]] and own[2] in v.shared
    assert v.counts.sum() == 11 and list(v.counts) == sorted(v.counts, reverse=True)


def test_probabilities_sum_to_one_and_gradient_matches_loops(spark):
    rng = np.random.default_rng(0)
    own, starts = rng.integers(0, lm.UNITS, 60).astype(np.uint16), np.array([0, 20, 20, 60])
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.arange(lm.UNITS, dtype=np.uint16), np.ones(lm.UNITS))
    m = lm.Model(v, *(rng.normal(size=s).astype(np.float32) for s in ((64,), (64, 64), (lm.WIDTH_C, 64), (lm.WIDTH_M, 64))))
    c = lm.contexts(own, starts)
    [(_, classes, ct, members, mt)] = list(lm.probabilities(m, c, slice(0, 60)))
    assert np.allclose((classes / ct[:, None]).sum(1), 1, atol=1e-5) and np.allclose((members / mt[:, None]).sum(1), 1, atol=1e-5)
    for k in (0, 19, 20, 59):  # plain loops
        z = [m.class_bias[x] + sum(m.class_rows[r[k], x] for r in c.class_rows) for x in range(64)]
        e = np.exp(np.array(z))
        assert np.allclose(classes[k] / ct[k], e / e.sum(), rtol=1e-3)
    into, want = np.zeros((lm.WIDTH_C, 64), np.float32), np.zeros((lm.WIDTH_C, 64))
    rows, values = rng.integers(0, 5, 200).astype(np.uint16), rng.random((200, 64)).astype(np.float32)
    lm._add_rows(into, rows, values)
    np.add.at(want, rows, values)
    assert np.allclose(into, want, rtol=1e-4)
    # the first word of a text sees no other text
    assert c.class_rows[0][0] == c.class_rows[0][20] and c.class_rows[1][0] == c.class_rows[1][20]


def loop_probabilities(m, c, k):
    """P(class) and P(member | class of the target) at a place, a number at a time."""
    out = []
    for bias, table, rows in ((m.class_bias, m.class_rows, c.class_rows), (m.member_bias[c.target_class[k]], m.member_rows, c.member_rows)):
        e = [math.exp(float(bias[x]) + sum(float(table[r[k], x]) for r in rows)) for x in range(64)]
        out.append([x / sum(e) for x in e])
    return out


TEXTS = ["b a c d d e a b", "a", "", "a b c x y z x", "f g h i j k l m n o p", "a b c d d e a b"]


def test_gradient_and_steps_match_loops(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    v = lm.vocabulary(docs, own=4)
    table = settle(lm.units(docs, v), "units")
    counts = lm._gathered(table.select("n_words", "units").mapInArrow(lm._pair_counts, lm._SUMS))
    rng = np.random.default_rng(3)
    m = lm.start_model(v, counts)
    m = m._replace(class_rows=m.class_rows + rng.normal(size=m.class_rows.shape).astype(np.float32) / 4)
    got = lm._gathered(table.select("n_words", "units").mapInArrow(lm._gradient(spark.sparkContext.broadcast(m)), lm._SUMS))
    want, seen = {k: np.zeros_like(x) for k, x in got.items()}, {k: np.zeros_like(x) for k, x in got.items()}
    for row in table.collect():
        own = np.frombuffer(row.units, np.uint16)
        c = lm.contexts(own, np.array([0, len(own)]))
        for k in range(len(own)):
            classes, members = loop_probabilities(m, c, k)
            for part, p, target, rows in (("class", classes, int(own[k]) // 64, c.class_rows), ("member", members, int(own[k]) % 64, c.member_rows)):
                for r in rows:
                    seen[part][r[k], target] += 1
                    for x in range(64):
                        want[part][r[k], x] += (x == target) - p[x]
    for part in got:
        assert np.allclose(counts[part], seen[part]) and np.allclose(got[part], want[part], atol=1e-3)
    stepped = lm.stepped(m, counts, want, 0.5)
    for part, before, after, base in (("class", m.class_rows, stepped.class_rows, np.exp(m.class_bias)[None, :]), ("member", m.member_rows, stepped.member_rows, np.repeat(np.exp(m.member_bias), lm.WIDTH_M // 64, 0))):
        step = lm.STEP * (want[part] - 0.5 * lm.RIDGE * before) / (0.5 * (seen[part] + lm.PRIOR * base + lm.RIDGE))
        assert np.allclose(after - before, np.clip(step, -1, 1), atol=1e-3)


def test_scores_match_loops_and_words_share_units(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    counts = lm.word_counts(docs)
    n = Counter(" ".join(TEXTS).split())
    hash_of = {w: int(words([w])[0][0]) for w in [*n, "never"]}
    assert {r.hash % 2**64: r.n for r in counts.collect()} == {hash_of[w]: k for w, k in n.items()}
    for listed in (0, 3, 1000):
        v = lm.vocabulary_of(counts, own=2, listed=listed)
        assert len(v.listed) <= listed and (listed < 1000 or len(v.listed) == len(n) - 2)
        table = settle(lm.units(docs, v), "units")
        m = lm.train_on(table, v)
        got = {r.doc_id: r for r in lm.scores(table, m, counts).collect()}
        seen = settle(lm.units(docs.limit(0).union(spark.createDataFrame([(9, "a never b")], docs.schema)), v), "units")
        got |= {r.doc_id: r for r in lm.scores(seen, m, counts).collect()}
        units = Counter()
        for w, k in n.items():
            units[int(lm.Lookup(v)(words([w])[0])[0])] += k
        for i, text in [*enumerate(TEXTS), (9, "a never b")]:
            own = lm.Lookup(v)(words([text])[0]) if text else np.zeros(0, np.uint16)
            c = lm.contexts(own, np.array([0, len(own)]))
            total = 0.0
            for k, w in enumerate(text.split()):
                classes, members = loop_probabilities(m, c, k)
                share = 1.0 if hash_of[w] in v.hashes else max(n[w], 1) / (units[int(own[k])] + 1)
                total += math.log(classes[own[k] // 64] * members[own[k] % 64] * share)
            assert got[i].n_words == len(text.split()) and got[i].log_prob == pytest.approx(total, abs=1e-3)
            assert got[i].bits_per_word is None if not text else got[i].bits_per_word == pytest.approx(-total / len(text.split()) / math.log(2), abs=1e-3)


def test_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").dropDuplicates(["text"])
    train, test = docs.filter("doc_id % 4 <> 0"), docs.filter("doc_id % 4 = 0")
    counts = lm.word_counts(train)
    v = lm.vocabulary_of(counts)
    m = lm.train_on(settle(lm.units(train, v), "units"), v)
    held = settle(lm.units(test, v), "held")
    total = lm.scores(held, m, counts).agg(F.sum("log_prob"), F.sum("n_words")).first()
    n = {r.hash % 2**64: r.n for r in counts.collect()}
    sizes, tokens = sum(n.values()), words([r.text for r in test.collect()])[0].tolist()
    alone = -sum(math.log2((n.get(t, 0) + (t not in n)) / (sizes + 1)) for t in tokens) / len(tokens)  # by words' counts alone
    assert -total[0] / total[1] / math.log(2) < alone - 0.1
    # and repeated lines are better known than shuffled ones
    row = test.orderBy(F.desc("n_chars")).first()
    tokens = row.text.split()
    np.random.default_rng(0).shuffle(tokens)
    seen = small_units(spark, [train.orderBy(F.desc("n_chars")).first().text, " ".join(tokens)], v)
    a, b = (r.bits_per_word for r in lm.scores(seen, m, counts).orderBy("doc_id").collect())
    assert a < b


def test_documents_that_occur_twice_are_told_apart(spark, data):
    """A text that the corpus has twice scores better than the same corpus without its second copy scores it."""
    docs = spark.read.parquet(f"{data}/documents.parquet").dropDuplicates(["text"]).select("doc_id", "text")
    again = docs.filter("doc_id % 10 = 3").select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text")
    once = {r.doc_id: r.bits_per_word for r in lm.score_documents(docs).collect()}
    twice = {r.doc_id: r.bits_per_word for r in lm.score_documents(docs.unionByName(again)).collect()}
    better = [once[i] - twice[i] for i in once if once[i] and i % 10 == 3]
    others = [once[i] - twice[i] for i in once if once[i] and i % 10 != 3]
    assert np.mean(better) > 0.05 and np.quantile(better, 0.1) > np.quantile(others, 0.9)


def test_scores_of_odd_rows(frame, odd):
    rows = lm.score_documents(frame(odd)).collect()
    assert len(rows) == len(odd)
    for r in rows:
        assert (r.n_words == 0) == (r.bits_per_word is None) and math.isfinite(r.log_prob)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3, 4)} == {0} and next(r.n_words for r in rows if r.doc_id == 5) == 200_000
    twice = [r.log_prob for r in rows if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1])
    assert lm.score_documents(frame([])).count() == 0
