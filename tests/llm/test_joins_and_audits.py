"""Whitening, the n-gram join and the filter audit against brute force, and on odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import audit, incidence, whitening
from tempora.session import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHES = ["row", "n", "i", "g", "v", "t", "root", "node", "mask", "part", "range", "step", "bit", "k1", "th", "prefix", "component", "elements"]
ODD = [(1, "a b c d e f " * 30, "en", "s", 3), (1, "a b c d e f " * 30, "en", "s", 3), (None, "x y", None, None, None), (None, "x y", None, None, None), (2, None, "en", None, None),
       (3, "", None, "s", 0), (3, "other TEXT $", "", "s", 0), (4, "word " * 30_000, "en", "s", 1), (5, "é\n\n \t" * 9, "fr", "é", 5), (6, "y" * 5000, "", "", 6),
       (7, None, None, None, None), (7, None, None, None, None), (8, "OTHER text $", "de", None, None), (9, "other TEXT $", "de", None, None)]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES if c not in df.columns})


def rows_of(df):
    return sorted(map(repr, df.collect()))


# ---- whitening -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("low,high", [(0, 1), (0, 2), (0, 5000), (0, 1 << 35)])
def test_bit_planes_give_exact_products(low, high):
    rng = np.random.default_rng(1)
    v = rng.integers(low, high, (131, 7))
    want = v.astype(object).T @ v.astype(object)
    assert (whitening.cross_products(v) == want).all()
    s, products = whitening.block_sums(v - 77)
    u = (v - 77).astype(object)
    assert (products == u.T @ u).all() and (s == u.sum(0)).all()


def vectors(spark, values, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in enumerate(values)],
                                 "vec_id long, embedding array<float>, label int").repartition(5)


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(2)
    values = (rng.normal(size=(700, 11)) @ rng.normal(size=(11, 11))).astype(np.float32)
    got = whitening.whiten(vectors(spark, values)).toPandas()
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in values]
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    assert len(got) == n * 8 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    for k in range(8):
        own = got[got.component == k + 1].sort_values("vec_id")
        want = centred @ axes[:, -1 - k] / np.sqrt(e[-1 - k])
        assert min(np.abs(own["whitened"] - want).max(), np.abs(own["whitened"] + want).max()) < 1e-8
        assert np.allclose(own["explained"], e[-1 - k] / np.trace(cov), rtol=1e-9)
        assert own["deviation"].tolist() == [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]


def test_whitening_drops_and_flat_parts(spark):
    bad = [None, [], [1, None], [1, float("nan")], [float("inf"), 0], [1, 2, 3], [1e30, 0]]
    good = [[1, 2], [2, 4], [3, 6], [3, 6]]
    df = clashing(vectors(spark, good + bad))
    got = whitening.whiten(df).toPandas()
    assert sorted(set(got["vec_id"])) == [0, 1, 2, 3] and len(got) == 8
    assert got[got.component == 2]["whitened"].isna().all() and got["identity_error"].max() < 1e-12
    assert np.allclose(got[got.component == 1]["explained"], 1)
    one = whitening.whiten(vectors(spark, [[1, 2]])).toPandas()
    assert one["whitened"].isna().all() and one["deviation"].tolist() == [0, 0]
    assert whitening.whiten(df.where("false")).collect() == []
    far = whitening.whiten(vectors(spark, [[1e9, 0]] * 3 + [[-1e9, 1]] * 3)).toPandas()
    assert far["deviation"].isna().all()  # beyond a long


# ---- n-gram join ---------------------------------------------------------------------------------------------------

def shingle_set(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"rows": 3, "rounds": 1, "cells": 1 << 16}, {"rounds": 0, "rows": 7}])
def test_incidence_join_by_brute_force(spark, options):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (100, 60, 150, 30, 9)]
    texts = [t for b in base for t in family(rng, b, 25, 4)]
    texts += [base[0][:len(base[0]) * 3 // 4] + f" own{i} " + " ".join(f"r{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(25))) for i in range(40)]  # a template with ends of its own
    texts += ["one", "ONE", "one two", "", None, "a b c d e f g h", "a b c d e f g h i", "A b c d e f g h"]
    docs = [(rng.randrange(10 ** 6), t) for t in texts] + [(7, base[1]), (7, base[2]), (None, base[3]), (None, "alone here")]
    rng.shuffle(docs)
    got = incidence.join_documents(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], SCHEMA).repartition(6), **options)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(docs)


def test_incidence_join_of_unlike_rows_under_one_column(spark):
    """A frequent passage in documents that are unlike each other makes no pairs but those within blocks, and no links."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(12))
    docs = [(i, passage + " " + " ".join(f"u{rng.randrange(10 ** 7)}" for _ in range(12))) for i in range(1500)]
    got = incidence.join_documents(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], SCHEMA).repartition(4), rows=100)
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 20 for r in got.collect())


def test_prefixes_and_needs(spark):
    sizes = [(a, b) for a in range(1, 40) for b in range(a, 50)]
    got = spark.createDataFrame(sizes, "x long, y long").select("x", "y", incidence.need(F.col("x"), F.col("y")).alias("m")).collect()
    for r in got:
        want = min((c for c in range(r.x + 1) if 100 * c >= 80 * (r.x + r.y - c)), default=None)
        assert want is None and r.m > r.x or r.m == want
        if want is not None:
            assert want >= r.x - incidence.prefix_length(np.int64(r.x)) + 1 and want >= r.y - incidence.prefix_length(np.int64(r.y)) + 1


def test_only_columns_of_several_rows_leave_a_task(spark):
    """Each row's prefix has 40 columns of its own and up to two that other rows have; some beyond them pass by chance."""
    rng = np.random.default_rng(3)
    own = rng.integers(-2 ** 63, 2 ** 63, (5000, 40))
    shared = rng.integers(-2 ** 63, 2 ** 63, 1000)
    prefixes = [[int(x) for x in row[:20]] + [int(shared[d % 1000])] * (d < 3000) + [int(x) for x in row[20:]] + [int(shared[7])] * (d == 9) for d, row in enumerate(own)]
    nodes = spark.createDataFrame([(d, 60, x) for d, x in enumerate(prefixes)], "node long, n long, prefix array<long>").repartition(7)
    got = incidence.prefix_entries(nodes).collect()
    want = {(int(shared[d % 1000]), d, 60, 20) for d in range(3000)} | {(int(shared[7]), 9, 60, 41)}
    assert want <= {(r.g, r.node, r.n, r.i) for r in got}
    assert len(got) < len(want) + 0.05 * own.size
    assert all(prefixes[r.node][r.i] == r.g and 0 < r.common <= 1 for r in got)
    assert incidence.prefix_entries(nodes.where("false")).collect() == []


def test_full_sets_are_gathered_once(spark):
    texts = [" ".join(f"w{d}x{i}" for i in range(30)) for d in range(400)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]], "text string").selectExpr("text", "xxhash64(text) AS th").repartition(5)
    keys = [incidence.set_keys(own) for own in incidence.parts(*incidence.shingles(pa.array(texts[:20]), 5))]
    named = spark.createDataFrame([(d, t, *k) for d, (t, k) in enumerate(zip(texts, keys))], "node long, text string, k1 long, k2 long")
    got = incidence._full_sets(docs, named.selectExpr("node", "k1", "k2", "xxhash64(text) AS th"), 5).collect()
    assert sorted(r.node for r in got) == list(range(20)) and {len(r.elements) for r in got} == {26}


def test_incidence_join_writes_neither_prefixes_nor_sets(spark):
    """The shared folder takes about 200 bytes a row; the prefixes of these rows have 490 bytes each and the sets 2,400."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10 ** 7)}" for _ in range(304)) for _ in range(3000)]
    texts += [t + " end" for t in texts[:600]]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in enumerate(texts)], SCHEMA).repartition(4)
    folder = Path(work_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    before = {*folder.rglob("*.parquet")}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in incidence.join_documents(docs).collect()}
    assert got == {d: (300 + (d >= 3000), d - 3000 * (d >= 3000)) for d in range(3600)}
    assert sum(f.stat().st_size for f in {*folder.rglob("*.parquet")} - before if f.is_file()) < 500 * len(texts)


def test_incidence_join_of_repeated_sets(spark):
    """Rows of one set in several partitions, some of them alike in all columns, count its columns once."""
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w59", "x")
    docs = [(d, t) for d in range(40) for t in (base, near.upper(), f"{d} only")] * 2
    got = incidence.join_documents(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], SCHEMA).repartition(9), rows=4)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(docs)


def test_incidence_join_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    got = incidence.join_documents(clashing(odd))
    assert Counter(tuple(r) for r in got.collect()) == brute_components([(r[0], r[1]) for r in ODD])
    assert incidence.join_documents(odd.where("false")).collect() == []


# ---- filter audit --------------------------------------------------------------------------------------------------

def brute_audit(docs, labels):
    lowest, masks, out = {}, [], {}
    for d, t, *_ in docs:
        if d is not None:
            lowest[t or ""] = min(d, lowest.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, x in labels if d is not None and x == 1}
    for d, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > lowest[t]}
        masks.append((lang or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    shares = defaultdict(int)
    for order in map("".join, permutations("ABCDE")):
        for part in {m[0] for m in masks}:
            for step, letter in enumerate(order, 1):
                row = [0] * 6
                for _, fails, g, x in (m for m in masks if m[0] == part):
                    at = next((i for i, f in enumerate(order, 1) if f in fails), 6)
                    row = [a + b for a, b in zip(row, (at > step, at == step, letter in fails and at < step, fails == {letter}, at == step and g, at == step and x))]
                out[part, order, step] = row
                shares[part, letter] += row[1]
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 300, "step": 50}])
def test_audit_by_brute_force(spark, sizes):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [long, long + " $", long.upper(), "a " * 300, "", "short", "Short & sweet", "x" * 500, "x" * 500 + "y", "x" * 499 + "z"]
    docs = [(rng.randrange(200), rng.choice(texts) + rng.choice(["", "", " tail"]), rng.choice(["en", "de", None, ""]), "s", 0) for _ in range(300)] + ODD
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = audit.audit(clashing(spark.createDataFrame(docs, SCHEMA).repartition(5)), clashing(spark.createDataFrame(labels, LABELS)), **sizes).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.audit(docs.where("false"), labels).collect() == []
    assert sum(r["good_lost"] + r["toxic_lost"] for r in audit.audit(docs, labels).collect()) == 0


def test_range_bounds_cover_all_texts(spark):
    rng = random.Random(9)
    texts = ["same start " * 40 + str(rng.randrange(10 ** 6)) for _ in range(400)] + ["copy " * 50] * 400 + [chr(97 + rng.randrange(26)) * rng.randrange(60) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    bounds = audit.range_bounds(docs, 20_000, 2_000)
    assert bounds == sorted(set(bounds)) and len(bounds) >= 5
    held = Counter(sum(t.encode() >= b for b in bounds) for t in set(texts))
    bytes_in = Counter()
    for t in set(texts):
        bytes_in[sum(t.encode() >= b for b in bounds)] += len(t)
    assert max(bytes_in.values()) < 20_000 + 5 * 4 * 2_000 and len(held) == len(bounds) + 1


def test_trie():
    trie, rows = audit.Trie(), [(b"abc", 5), (b"ab", 4), (b"abd", 3), (b"abc", 2), (b"", 9), (b"abcdef", 1), (b"", 7)]
    for i, (t, d) in enumerate(rows):
        trie.insert(t, d, i)
    assert sorted((n.low, sorted(n.rows)) for n in trie.terminals()) == [(1, [5]), (2, [0, 3]), (3, [2]), (4, [1]), (7, [4, 6])]
