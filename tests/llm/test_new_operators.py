"""Spelling variants, source divergence and nearest neighbours against brute force on small tables."""

import glob
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import learned_ann, source_divergence, spelling
from pulsegrid.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, term string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= 7:
                    counts[word] += 1
            run = ""
    n = {w: k for w, k in counts.items() if k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_variants_equal_brute_force(spark):
    """Chains of forms, ties, accents, edits at either end, null and empty texts, repeated rows, other columns of clashing names."""
    words = ["abcdefgh", "abcdefg", "abcdefghi", "xabcdefgh", "abcdefgx", "ÀÉîõüßÿ", "Àéîõüßÿ", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "kitchens", "kitchenz", "kittens", "sittens"]
    docs = [(i, " ".join(w for j, w in enumerate(words) for _ in range(1 + 12 * ((i * j) % 3 == 0))), "x", None, None, "w", 1, "t") for i in range(40)]
    docs += [(100, " ".join(["abcdefgh"] * 900 + ["Abcdefghi"] * 9), None, None, None, None, None, None), (None, "kitchens kitchens 12kitchens÷kitchens", *[None] * 6), (7, None, *[None] * 6), (8, "", *[None] * 6), (102, "gardener " * 1000 + "gardenex " * 50 + "gardenxx " * 3, *[None] * 6)]
    docs += [docs[3], docs[3], (9, "zyxwvuts " * 30_000, *[None] * 6)]
    found = rows_of(spelling.spelling_variants(spark.createDataFrame(docs, DOCS).repartition(5)))
    assert found == plain_variants([d[:2] for d in docs])
    assert any(r[1] for r in found)
    assert any(r[1] and r[1] != r[2] for r in found)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []


def test_variants_of_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_spelling_variants"](spark, DATA).select("word", "form", "root", "n", "n_near", "form_n")) == plain_variants(docs)


# ---------------------------------------------------------------- divergence


@given(st.lists(st.tuples(st.text("abé中", min_size=1, max_size=6) | st.text("ab", min_size=60, max_size=90), st.integers(1, 3), st.sampled_from("xyz")), max_size=60), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_tries_walk_in_utf8_order_and_merge_by_ranges(entries, cut):
    """Tries of two tasks, cut by prefix and merged, hold what one count holds; keys longer than what is compared as well."""
    want = defaultdict(lambda: [0, Counter()])
    ranges = defaultdict(source_divergence.Merging)
    for part in (entries[:cut], entries[cut:]):
        documents, by_source = Counter(), defaultdict(Counter)
        for term, n, source in part:
            documents[term.encode()] += 1
            by_source[source][term.encode()] += n
            want[term.encode()][0] += 1
            want[term.encode()][1][source] += n
        trie = source_divergence.RadixTrie.of(documents, by_source)
        assert [(k, d) for k, d, _ in trie.walk()] == sorted(documents.items())
        assert {k: c for k, _, c in trie.walk()} == {k: {s: c[k] for s, c in by_source.items() if k in c} for k in documents}
        for row in trie.ranges("x").to_pylist():
            ranges[row["prefix"]].add(*[row[c] for c in ("shared", "labels", "documents", "widths", "sources", "counts")])
    found = [(k, d, dict(c)) for p in sorted(ranges) for k, (d, c) in ranges[p].walk(1)]
    assert sorted(found) == sorted((k, d, dict(c)) for k, (d, c) in want.items())
    assert all(k[:3] == p for p, m in ranges.items() for k, _ in m.walk(0))


def plain_divergence(docs, least, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c > "\x7f" or "a" <= c <= "z" else " " for c in text or "")
        terms = low.split(" ")
        terms = [t for t in terms if t]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=lambda t: t.encode())
        sources = [s for x, s in groups if x == lang]
        share = lambda c, total, v=len(kept): 1 + int(Fraction(10**9 * (c + 5), total + 5 * v))
        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: [share(counts[lang, s][t], totals[s]) for t in kept] for s in sources}
        q = [share(sum(counts[lang, s][t] for s in sources), sum(totals.values())) for t in kept]
        for s in sources:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            more = [(t, p[s][i] - q[i]) for i, t in enumerate(kept) if counts[lang, s][t] and p[s][i] > q[i]]
            for part, items, most in (("pair", pairs, None), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(items[:most])]
    return sorted(out, key=repr)


def divergence_docs():
    rng = np.random.default_rng(3)
    words = ["the", "The", "straße", "中文", "été", "a", "zz", "über", "tie", "tia", "\U0001f600x", "\x85q"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 40))), ["en", "de", None, ""][i % 4], [None, "s1", "s2", "é"][i % 7 % 4], None, None, None, None) for i in range(160)]
    return docs + [(1, None, "en", "none", *[None] * 4), (2, "", "xx", "lone", *[None] * 4), (3, "rare words", "xx", None, *[None] * 4), docs[5], docs[5], (9, "the 1a2b the-the " * 40_000, "en", "s1", 1, "w", 2, "t")]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    """Ties, nulls, groups without terms, languages without kept terms; also in slices, blocks and flushes of a few."""
    if small:
        for name, n in (("HELD", 9), ("SLICE", 3), ("BLOCK", 2), ("SOURCES", 2)):
            monkeypatch.setattr(source_divergence, name, n)
    docs = divergence_docs()
    found = source_divergence.source_divergence(spark.createDataFrame(docs, DOCS).repartition(6), least=12, top=9)
    assert rows_of(found.select("lang", "source", "part", "item", "value", "rank")) == plain_divergence([d[1:4] for d in docs], 12, 9)


def test_divergence_of_nothing(spark):
    assert source_divergence.source_divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{glob.glob(f'{DATA}/documents.parquet')[0]}')")
    want = con.execute(source_divergence.SQL)
    names = [d[0] for d in want.description]
    assert rows_of(QUERIES["op12_source_divergence"](spark, DATA).select(*names)) == sorted(want.fetchall(), key=repr)


def test_shares_are_exact_for_large_counts():
    for count, total, v in ((0, 0, 1), (10**13, 2 * 10**13, 10**6), (2 * 10**14, 2 * 10**14 + 7, 3)):
        assert int(source_divergence.shares(np.array([count]), np.array([total]), v)[0]) == 1 + int(Fraction(10**9 * (count + 5), total + 5 * v))


# ---------------------------------------------------------------- neighbours


def plain_neighbours(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = out.setdefault(i, {})
            for j, v in good:
                if j != i and len(v) == len(q):
                    best[j] = min(best.get(j, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
    return {i: sorted((d, j) for j, d in best.items())[:k] for i, best in out.items()}


def test_neighbours_recall_and_scores(spark):
    """At least 0.9 of the true neighbours over the whole table, every score exact, ranks in order."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    vector, want = {i: np.array(v, float) for i, v in rows}, plain_neighbours(rows)
    found = defaultdict(list)
    for r in QUERIES["op13_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect():
        assert r.score == float(np.sqrt(((vector[r.vec_id] - vector[r.query_id]) ** 2).sum()))
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    assert set(found) == set(want)
    for q, got in found.items():
        assert [g[0] for g in sorted(got)] == list(range(1, 11))
        assert sorted(g[1:] for g in got) == [g[1:] for g in sorted(got)]
    hit = sum(len({j for _, j in want[q]} & {g[2] for g in found[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)


def test_neighbours_of_odd_rows(spark):
    """Nulls, zeros, infinities, other lengths, a large group of copies, repeated ids and rows: as brute force where parts are few."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(260)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(-3, 300)]
    rows += [(400, None), (500, [0.0] * 4), (600, [1.0, None, 2.0, 3.0]), (700, [float("inf"), 1.0, 1.0, 1.0]), (800, [float("nan")] * 4), (None, [1.0] * 4), (900, [])]
    rows += [(2000, [1.0, 2.0]), (2001, [1.0, 2.5]), (2002, [4.0, 2.5]), (2100, [7.0]), (100, [9.0] * 4), (-200, [1.0, 2.0, 3.0, 4.0]), rows[3], rows[3], rows[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, rank int").repartition(7)
    found = defaultdict(list)
    for r in learned_ann.nearest_neighbours(df, covered=2.0).collect():  # every part
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    want = {q: [(n + 1, d, j) for n, (d, j) in enumerate(best)] for q, best in plain_neighbours(rows).items() if best}
    assert {q: sorted(g) for q, g in found.items()} == want


def test_neighbours_of_nothing(spark):
    assert learned_ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    alone = spark.createDataFrame([(100, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert learned_ann.nearest_neighbours(alone).collect() == []


def test_parts_are_balanced_and_routing_finds_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 24))
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 24)) for c in centres])
    label = learned_ann.balanced_parts(x, learned_ann.neighbour_graph(x), 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.05 * len(x) / 8)
    router = learned_ann.fit(x, 8)
    fresh = np.concatenate([c + 0.05 * rng.normal(size=(5, 24)) for c in centres])
    d = ((fresh[:, None] - x[None]) ** 2).sum(-1)
    nearest, own = np.argsort(d, 1)[:, :10], router.probabilities(x).argmax(1)
    order = np.argsort(-router.probabilities(fresh), 1)[:, :2]
    assert np.mean([np.isin(own[nearest[i]], order[i]).mean() for i in range(len(fresh))]) > 0.95
