"""Exact search, hard negatives and the source audit against brute force."""

import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from reviewlens.llm import exact_search, hard_negatives, source_audit, vectors  # noqa: E402

#: So small that every query meets many blocks, parts and chunks.
SMALL = vectors.Sizes(block_rows=16, part_rows=64, chunk_rows=3, least_chunks=2)


def whole_vectors(rows, factor, label):
    """Rows that take part: one for each id, the smallest label, then vector."""
    found = {}
    for r in rows:
        if r.vec_id is None or r.embedding is None or label(r) is None:
            continue
        if any(x is None or not math.isfinite(x) for x in r.embedding):
            continue
        made = (label(r), [math.floor(factor * x) for x in r.embedding])
        found[r.vec_id] = min(found.get(r.vec_id, made), made)
    return found


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def searched(rows, k=20, every=20):
    found = whole_vectors(rows, 64, lambda r: 0)
    out = []
    for q, (_, v) in found.items():
        if q % every == 0:
            scored = sorted((-product(v, w), i) for i, (_, w) in found.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return out


def mined(rows, k=5, every=100):
    found = whole_vectors(rows, 256, lambda r: r.label)
    out = []
    for a, (label, v) in found.items():
        if a % every:
            continue
        scored = sorted((-product(v, w), i, other) for i, (other, w) in found.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(a, i, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("cut", [SMALL, vectors.Sizes()], ids=["many cells", "one cell"])
def test_exact_search(spark, cut):
    df = cases.embeddings(spark)
    expected = searched(df.collect())
    assert len(expected) > 300
    assert sorted(map(tuple, exact_search.top_k(df, cut=cut).collect())) == sorted(expected)


@pytest.mark.parametrize("cut", [SMALL, vectors.Sizes()], ids=["many cells", "one cell"])
def test_hard_negatives(spark, cut):
    df = cases.embeddings(spark)
    expected = mined(df.collect(), every=20)
    assert len(expected) > 60
    found = hard_negatives.mine(df, F.col("label"), every=20, depth=2, cut=cut)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_products_beyond_doubles_are_exact(spark):
    rows = [(20 * i, [float(2**20 + i), float(2**22 - i), 3.0 * i], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert max(r[3] for r in searched(df.collect())) > 1 << 53
    assert sorted(map(tuple, exact_search.top_k(df, cut=SMALL).collect())) == sorted(searched(df.collect()))
    found = hard_negatives.mine(df, F.col("label"), every=20, cut=SMALL).collect()
    assert sorted(map(tuple, found)) == sorted(mined(df.collect(), every=20))


def test_bounds_drop_candidates():
    rng = np.random.default_rng(5)
    columns = np.floor(rng.normal(size=(32, 500)) * 64)
    query = columns[:, 0] + 1
    squares = columns**2
    rests = [np.sqrt(squares[at:].sum(axis=0)) for at in range(0, 36, 4)]
    sums = query @ columns
    least = np.sort(sums)[-3]
    places, found = exact_search.survivors(query, columns, rests, np.arange(500), 3, least, 4)
    assert len(places) < 250 and set(np.flatnonzero(sums >= least)) <= set(places)
    assert np.array_equal(found, sums[places])


def test_the_threshold_stops_early():
    rng = np.random.default_rng(6)
    columns = np.floor(rng.normal(size=(2, 4000)) * 64)
    anchor = np.array([3.0, -2.0])
    lists, read = hard_negatives.SortedLists(columns), 0
    windows = hard_negatives.Windows([(-np.inf, np.inf)], 5)
    for new, scores, threshold in lists.rounds(anchor, 4):
        read += len(new)
        windows.add(scores, new)
        if windows.settled(threshold):
            break
    assert read < 2000
    every = anchor @ columns
    assert windows.ids[0].tolist() == sorted(range(4000), key=lambda i: (-every[i], i))[:5]


def brute_audit(rows, least, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(terms.findall((text or "").translate(lower)))
        counts[lang or "", source or ""] += found
        documents[lang or ""].update(found.keys())
    out = []
    for lang in documents:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = [s for g, s in counts if g == lang]

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found if part == "pair" else found[:top], 1):
                    out.append((lang, s, part, item, value, rank))
    return out


def test_source_audit(spark):
    rows = [(t, lang, f"src{k % 7}") for k, (_, t, *_) in enumerate(cases.rows()) for lang in ("en", "ß")]
    rows += [(cases.BASE, "en", "many copies")] * 9 + [(cases.EDITED, None, None), (None, "en", "no text")]
    rows += [("Only here", "xx", "a"), ("12 34", "xx", "b"), ("", "yy", "alone")]
    docs = spark.createDataFrame(
        [(*r, "k", 1) for r in rows], "text string, lang string, source string, key string, n int"
    ).repartition(4)
    for settings in (
        source_audit.Settings(least_documents=4, terms=10, tile=3, block_terms=16, held=50),
        source_audit.Settings(least_documents=1),
        source_audit.Settings(least_documents=10_000),
    ):
        found = source_audit.audit(docs, settings).collect()
        expected = brute_audit(rows, settings.least_documents, settings.terms)
        assert sorted(map(tuple, found)) == sorted(expected)


def test_shares_of_very_large_counts(spark):
    counts = spark.createDataFrame([(10**15, 3 * 10**15, 70), (0, 0, 0)], "n bigint, all_terms bigint, kinds bigint")
    found = [r[0] for r in counts.select(source_audit.share(F.col("n"), source_audit.Settings())).collect()]
    assert found == [1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 350), None]
