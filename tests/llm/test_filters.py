"""Toxicity, exact copies, near copies, against brute force and on odd rows."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from textloom.llm import exact, near, toxicity


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- toxicity


ALIKE = {
    "a": "а@4", "b": "ь8", "c": "с", "e": "е3", "i": "іl1|", "o": "о0", "p": "р", "s": "ѕ$5ß", "t": "т7", "u": "υ", "y": "у",
}


def brute_fold(text):
    """A character at a time."""
    to = {c: k for k, v in ALIKE.items() for c in v}
    out = ""
    for c in unicodedata.normalize("NFKD", re.sub("[\u00ad\u200b-\u200f\u2060\ufeff]", "", text).replace("ß", "s")).lower():
        if unicodedata.category(c) != "Mn":
            c = to.get(c, c)
            out += c if re.match("[a-z0-9]", c) else " "
    return re.sub(r"([a-z])\1\1+", r"\1", re.sub(" +", " ", out)).strip()


def brute_hits(text, lang, lexicon=toxicity.LEXICON, exceptions=toxicity.EXCEPTIONS, beginnings=None):
    """Weights of the terms that count: every term at every word."""
    words = brute_fold(text).split()
    terms = []
    for (own, term), weight in lexicon.items():
        folded = brute_fold(term)
        single = re.sub(r"(.)\1", r"\1", folded)
        for x in {folded, single}:
            terms.append((own, x.split(), weight))
            if len(x) > 3 and " " not in x:
                terms.append((own, list(x), weight))
    safe = [(k, k + len(p)) for p in (brute_fold(x).split() for x in exceptions) for k in range(len(words)) if words[k : k + len(p)] == p]
    out = []
    for k in range(len(words)):
        found = [(w, k + len(t)) for own, t, w in terms if own in ("", lang) and words[k : k + len(t)] == t]
        found += [(w, k + 1) for (own, p), w in (beginnings or {}).items() if own == lang and (words[k] + " ").startswith(p)]
        if found and not any(a <= k and max(found)[1] <= b for a, b in safe):
            out.append(max(found)[0])
    return out


def brute_score(text, lang, **lists):
    return 1000 * sum(brute_hits(text, lang, **lists)) / max(len(text), toxicity.FLOOR_CHARS)


TOXIC = [
    "You are an idiot.", "you 1D10T", "such a cl0wn", "mor0n, L0SER!", "іdіоt in other letters", "Ídiöt", "sтupid", "(scum)", "idi\u0308ot", "id\u00adiot", "i\u200bdiot",
    "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "ｉｄｉｏｔ", "i d i o t", "i.d.i.o.t", "idiooot", "IDIIIIOT", "assssshole", "ashole", "stupid_thing", "kill  yourself", "go\ndie",
]
CLEAN = [
    "the trash can is full", "a clown fish", "idiotic", "classic", "scumbled paint", "password=1d1, ab12", "a guinea pig", "", "nothing", "i d i o", "id iot", "arschloch", "looser", "the take out the trash can",
]


def found_in(text, lang="en", **lists):
    matcher = toxicity.Matcher(lists.pop("lexicon", toxicity.LEXICON), lists.pop("exceptions", toxicity.EXCEPTIONS), **lists)
    return matcher.found(*toxicity._fold(["before. idiot", text, "idiot"]), ["en", lang, "en"]).get(1, [])


@pytest.mark.parametrize("text", TOXIC + CLEAN)
def test_toxicity_of_phrases(text):
    assert toxicity.fold(text) == brute_fold(text)
    found = found_in(text)
    assert sorted(found) == sorted(brute_hits(text, "en"))
    assert bool(found) == (text in TOXIC)


def test_toxicity_by_language_and_overlap():
    assert found_in("du arschloch", "de") and not found_in("du arschloch", "fr")
    assert found_in("piece of shit") == [1.5]
    lists = {"lexicon": {("", "a b"): 1.0, ("", "b c"): 2.0, ("", "a b c"): 4.0, ("en", "b"): 3.0}, "exceptions": ("b c", "x a b", "c y")}
    assert found_in("a b d", **lists) == [1.0, 3.0]
    assert found_in("a b c", **lists) == [4.0]  # b c is covered, a b c isn't
    assert found_in("x a b d", **lists) == []
    assert found_in("x a b c y", **lists) == [4.0]  # two phrases cover it only together
    own = {"lexicon": {}, "exceptions": (), "beginnings": {("en", "foob"): 1.0, ("en", "bar "): 2.0}}
    assert found_in("foobar bar barn foo", **own) == [1.0, 2.0] and found_in("foobar", "de", **own) == []


def brute_learned(rows, labels):
    """(language, beginning) -> weight by plain loops: all ways to choose entries are tried by recursion over the tree."""
    marks = {}
    for i, x in labels:
        if i is not None and x is not None:
            marks[i] = max(x, marks.get(i, 0))
    firsts = {}
    for i, lang, text in sorted((r for r in rows if r[0] in marks), key=lambda r: r[0]):
        words = brute_fold(text or "").split()
        if words:
            firsts.setdefault((lang or "", marks[i], min(words, key=lambda w: (-len(w), w))), set(words))
    out = {}
    for lang in {k[0] for k in firsts}:
        counts = {0: Counter(), 1: Counter()}
        totals = [0, 0]
        for (own, toxic, _), words in firsts.items():
            if own == lang:
                totals[toxic] += len(words)
                counts[toxic].update(w[:k] for w in (x + " " for x in words) for k in range(3, min(12, len(w)) + 1))
        gains = {}
        for p, t in counts[1].items():
            if t >= 3 and all(totals):
                toxic, clean = t / totals[1], (counts[0][p] + 1) / totals[0]
                if toxic > clean and (gain := t * math.log(toxic / clean) - totals[1] * (toxic - clean) - 10) > 0:
                    gains[p] = (gain, math.log(toxic / clean) / 12)
        inner = {p[:k] for p in gains for k in range(3, len(p))}

        def best(p):
            below = [best(q) for q in {q for q in inner | set(gains) if len(q) == len(p) + 1 and q.startswith(p)}]
            rest = sum(x[0] for x in below), [y for x in below for y in x[1]]
            own = gains.get(p, (0, 0))[0]
            return (own, [p]) if own > rest[0] + 1e-6 else rest

        for root in {p[:3] for p in gains}:
            out |= {(lang, p): gains[p][1] for p in best(root)[1]}
    return out


@pytest.fixture
def marked(spark):
    """Documents in two languages whose toxic ones have words that begin alike, and labels."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["ba", "do", "ki", "lu", "me"], k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        lang, toxic = rng.choice(["xx", "yy", None]), int(rng.random() < 0.25)
        words = [word() for _ in range(rng.randint(5, 60))]
        if toxic:
            step = rng.randint(3, 9)
            words[::step] = [("zut" if lang == "xx" else "pfui") + word() for _ in words[::step]]
        rows.append((i, lang, " ".join(words)))
        if i % 2:
            labels.append((i, toxic))
    rows += [(1000, "xx", None), (1001, "xx", ""), (None, "xx", "zutba")]
    labels += [(1000, 1), (1001, 0), (None, 1), (2, None), (4000, 1), (1, 1), (1, 0)]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_terms_against_brute_force(marked, spark):
    rows, labels, docs, marks = marked
    got, want = toxicity.learned(docs, marks), brute_learned(rows, labels)
    assert got == pytest.approx(want) and ("xx", "zut") in got and len({k for k, _ in got}) == 3
    assert toxicity.learned(docs, marks.limit(0)) == {} == toxicity.learned(docs, marks.filter("toxic = 0"))
    assert toxicity.learned(docs.limit(0), marks) == {}
    assert 0 < toxicity.word_counts(docs, marks, rows=100).agg({"t": "sum"}).first()[0] < toxicity.word_counts(docs, marks).agg({"t": "sum"}).first()[0]


def test_learned_terms_find_documents_without_a_label(marked):
    rows, labels, docs, marks = marked
    known = {i for i, _ in labels}
    found = {r.doc_id for r in toxicity.toxic_documents(docs, marks, lexicon={}, exceptions=()).collect()}
    toxic = {i for i, _, text in rows if i is not None and text and re.search(r"\b(zut|pfui)", text)}
    assert len(found & toxic - known) >= 0.95 * len(toxic - known) and len(found - toxic) <= 5


def test_toxicity_against_brute_force(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = docs.collect()
    beginnings = brute_learned([(r.doc_id, r.lang, r.text) for r in rows], [(r.doc_id, r.toxic) for r in labels.collect()])
    want = {r.doc_id: round(s, 6) for r in rows if (s := brute_score(r.text, r.lang, beginnings=beginnings)) >= toxicity.THRESHOLD}
    assert {r.doc_id: r.score for r in toxicity.toxic_documents(docs, labels).collect()} == want
    assert want


def test_toxicity_of_held_out_labels(spark, data):
    """Half of the families of documents (by longest word) are learnt from, the other half is judged."""
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/{t}.parquet") for t in ("documents", "labels"))
    side = {r.doc_id: hash_of(max(r.text.lower().split() or [""], key=lambda w: (len(w), w))) % 2 for r in docs.join(labels, "doc_id").select("doc_id", "text").collect()}
    half = spark.createDataFrame([(i, s) for i, s in side.items()], "doc_id long, side int")
    fit = labels.join(half.filter("side = 0"), "doc_id")
    found = {r.doc_id for r in toxicity.toxic_documents(docs, fit).collect()}
    held = [r for r in labels.collect() if side.get(r.doc_id) == 1]
    toxic, clean = ([r.doc_id in found for r in held if r.toxic == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def hash_of(word):
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:4], "big")


def test_toxicity_of_odd_rows(frame, odd, spark):
    docs = frame([*odd, (20, "idiot"), (20, "idiot"), (21, "word " * 100_000 + "idiot")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (20, None), (5, 0), (20, 1)], "doc_id long, toxic int")
    for marks in (None, labels, labels.limit(0)):
        assert [tuple(r)[0] for r in toxicity.toxic_documents(docs, marks).collect()] == [20, 20]
        kept = toxicity.drop_toxic(docs, marks)
        assert kept.columns == docs.columns and kept.count() == len(odd) + 1
        assert toxicity.toxic_documents(frame([]), marks).count() == 0 == toxicity.drop_toxic(frame([]), marks).count()


def test_toxicity_lists(frame):
    docs = frame([(1, "foo bar"), (2, "foo baz foo")])
    assert [r.doc_id for r in toxicity.toxic_documents(docs, lexicon={("", "foo"): 1.0}, exceptions=("foo bar",)).collect()] == [2]
    assert toxicity.toxic_documents(docs, lexicon={}, exceptions=()).count() == 0


# ---------------------------------------------------------------- exact copies


def brute_copies(rows):
    groups = {}
    for i, t in rows:
        if i is not None and t is not None:
            groups.setdefault(t, []).append(i)
    return sorted(((i, min(g), len(g), i != min(g)) for g in groups.values() if len(g) > 1 for i in set(g)), key=str)


def test_exact_copies_against_brute_force(spark, data, frame):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert rows_of(exact.exact_copies(docs)) == brute_copies([(r.doc_id, r.text) for r in docs.collect()])


def test_exact_copies_of_odd_rows(frame, odd):
    long = odd[4][1]
    rows = [*odd, (30, long), (31, long + "x"), (32, "x" + long)]
    assert rows_of(exact.exact_copies(frame(rows))) == brute_copies(rows)
    kept = exact.drop_copies(frame(rows))
    assert kept.columns == frame(rows).columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    want, seen = Counter(), set()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or t is None or t not in seen:
            want[i, t] += 1
        if i is not None and t is not None:
            seen.add(t)
    assert left == want
    assert exact.drop_copies(frame([])).count() == 0


def test_cuts_depend_on_the_text_alone():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdef ", k=n)) for n in (0, 5, 300, 40_000, 9_000)]
    joined, begins, ends, counts = exact._chunked(texts)
    at = 0
    for t, n in zip(texts, counts):
        alone = exact._chunked([t])
        assert [joined[b:e] for b, e in zip(begins[at : at + n], ends[at : at + n])] == [alone[0][b:e] for b, e in zip(alone[1], alone[2])]
        at += n
    assert joined == "".join(texts).encode() and max(ends - begins) <= exact.MAX_CHUNK
    # an insertion leaves most chunks as they were
    a, b = exact._chunked([texts[3]]), exact._chunked(["zz" + texts[3]])
    pieces = [{x[0][s:e] for s, e in zip(x[1], x[2])} for x in (a, b)]
    assert len(pieces[0] & pieces[1]) >= 0.8 * len(pieces[0])


def test_collided_hashes_are_told_apart(spark):
    chunks = spark.createDataFrame([(1, 1, 0, 7, b"a"), (2, 2, 0, 7, b"b"), (3, 3, 0, 7, b"a"), (4, 4, 0, 9, b"c")], "doc_id long, key long, seq long, hash long, chunk binary")
    ranks = {r.doc_id: (r.hash, r.rank) for r in exact.verified_identifiers(chunks).collect()}
    assert ranks[1] == ranks[3] != ranks[2] and ranks[4] == (9, 0)


# ---------------------------------------------------------------- near copies


def sets_of(texts):
    grams, begins = near.shingle_sets(texts)
    return [set(grams[a:b].tolist()) for a, b in zip(begins[:-1], begins[1:])]


def brute_groups(rows, threshold=near.THRESHOLD):
    rows = [r for r in rows if r[0] is not None and r[1] is not None]
    sets, up = sets_of([t for _, t in rows]), {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    pairs = []
    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) and rows[k][0] != rows[j][0]:
                pairs.append((rows[j][0], rows[k][0]))
                x, y = sorted((root(rows[j][0]), root(rows[k][0])))
                up[y] = x
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), []).append(x)
    return pairs, {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def planted(seed=3, groups=40, size=6):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(30, 300))
        for _ in range(size):
            copy = [rng.choice(words) if rng.random() < 0.05 else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(rng.choices(words, k=80))) for k in range(100)]
    return rows


@pytest.mark.parametrize("most_rows", [near.MOST_ROWS, 20])
def test_near_copies_against_brute_force(frame, most_rows):
    rows = planted() if most_rows > 100 else planted(4, 3, 60)
    pairs, groups = brute_groups(rows)
    found = {r.doc_id: r.first_id for r in near.near_groups(frame(rows), most_rows=most_rows).collect()}
    together = [found.get(a, -1) == found.get(b, -2) for a, b in pairs]
    assert sum(together) >= 0.9 * len(together) and len(together) > 100
    assert set(found) <= set(groups)  # no clean document is in a group


@pytest.fixture
def small_batches(spark):
    """A node that comes in one batch is compared whatever its size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_of_copies_in_nodes_too_large_for_a_task(frame, small_batches):
    """Each y is near its x alone, and x is clearly a copy of the pivot that all share, which y isn't near."""
    word = iter(f"w{k}" for k in range(10_000)).__next__
    common = [word() for _ in range(300)]
    rows, chains = [(0, " ".join(common))], []
    for k in range(1, 41):
        own = [word() for _ in range(30)]
        rows += [(k, " ".join(common[30:] + own)), (100 + k, " ".join(common[120:] + own + [word() for _ in range(70)]))]
        chains.append((k, 100 + k))
    pairs, _ = brute_groups(rows)
    assert set(chains) <= set(pairs) and not any(x > 100 or y > 100 for x, y in set(pairs) - set(chains))
    for most_rows in (near.MOST_ROWS, 20):
        found = {r.doc_id: r.first_id for r in near.near_groups(frame(rows), most_rows=most_rows).collect()}
        together = [found.get(x, -1) == found.get(y, -2) for x, y in chains]
        assert sum(together) >= 0.9 * len(chains), (most_rows, sum(together))


def test_near_copies_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    _, groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    found = near.near_groups(docs).collect()
    assert {r.doc_id: r.first_id for r in found} == groups
    sizes = Counter(r.first_id for r in found)
    assert all(r.group_size == sizes[r.first_id] for r in found)


def test_links_are_all_pairs_of_the_table(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pairs, groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    links = Counter(x for p in pairs for x in p)
    found = near.near_links(docs).collect()
    assert {r.doc_id: (r.first_id, r.links) for r in found} == {i: (g, links[i]) for i, g in groups.items()}


@pytest.mark.parametrize(("grams", "tile"), [(1 << 22, 512), (2000, 7), (100, 512)])
def test_link_counts_in_blocks(spark, grams, tile, monkeypatch):
    monkeypatch.setattr(near, "TILE", tile)  # workers keep theirs; the function is called here too
    rows = planted(5, 3, 30)[:90]
    sets = [np.array(sorted(x), np.uint32) for x in sets_of([t for _, t in rows])]
    copies = [1 + k % 3 for k in range(len(rows))]
    pairs, _ = brute_groups(rows)
    want = Counter()
    for a, b in pairs:
        if a // 30 == b // 30:
            want[a] += copies[b]
            want[b] += copies[a]
    table = spark.createDataFrame([(i, i // 30, bytearray(s.tobytes()), c) for (i, _), s, c in zip(rows, sets, copies)], "doc_id long, first_id long, grams binary, copies long")
    assert {r.doc_id: r.n for r in near.link_counts(table, block_grams=grams).collect()} == {i: want[i] for i, _ in rows}
    n = near._counts(None, np.array(copies[:30]), sets[:30], near.THRESHOLD)
    assert n.tolist() == [want[i] for i in range(30)]


def family(n, seed=7):
    """Sets of which any two are about half alike, on both sides of the threshold."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(210)]
    return [(k, " ".join(common[: rng.choice([190, 200, 210])] + [f"w{rng.randrange(10**9)}" for _ in range(90)])) for k in range(n)]


@pytest.mark.parametrize("most_rows", [near.MOST_ROWS, 150])
def test_a_family_that_is_half_alike(frame, most_rows, monkeypatch):
    rows = family(600)
    pairs, groups = brute_groups(rows)
    seen = []
    verified = near._verified
    monkeypatch.setattr(near, "_verified", lambda links, *x: (seen.append(links.count()), verified(links, *x))[1])
    found = {r.doc_id: r.first_id for r in near.near_groups(frame(rows), most_rows=most_rows).collect()}
    assert len(pairs) > 50_000 and found == groups and sum(seen) < 12 * len(rows)


def test_roots_reach_the_recall_at_any_depth():
    assert near.survival(0.5, 3) == pytest.approx(0.7639, abs=1e-4)
    assert 1 - (1 - near.THRESHOLD * near.survival()) ** near.ROOTS >= near.RECALL > 1 - (1 - near.THRESHOLD * near.survival()) ** (near.ROOTS - 1)


def test_large_nodes(monkeypatch):
    rng = np.random.default_rng(0)
    bases = rng.integers(0, 256, (30, near.COORDINATES), dtype=np.uint8)
    sig = np.repeat(bases, 40, 0)
    change = rng.random(sig.shape) < 0.1
    sig[change] = rng.integers(0, 256, change.sum())
    links = [x for seed in range(5) for x in near.compare_node(sig, seed)[0]]
    forest = near.Forest(len(sig))
    for a, b in links:
        forest.join(a, b)
        assert a // 40 == b // 40
    assert len({forest.root(k) for k in range(len(sig))}) == 30 and len(links) < 5 * len(sig)


def test_near_copies_of_odd_rows(frame, odd):
    long = odd[4][1]
    rows = [*odd, (40, long + "more"), (41, "One, two!")]
    found = {r.doc_id: r.first_id for r in near.near_groups(frame(rows)).collect()}
    assert found == brute_groups(rows)[1] == {5: 5, 40: 5, 6: 6, 7: 6, 41: 6}
    kept = near.drop_near(frame(rows))
    assert kept.columns == frame(rows).columns
    gone = [7, 7, 40, 41]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in gone)
    twice = near.drop_near(frame([(1, "a b c d"), (1, "a b c d"), (2, "x y z")]))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 2]
    assert near.near_groups(frame([])).count() == 0 == near.drop_near(frame([])).count()


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(1, 60)]
    star = [(100, k) for k in range(101, 160)]
    got = {r.doc_id: r.first_id for r in near.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 160)}}
