"""The corpus operators against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempora.llm import bits, chat, components, fingerprints, hashing, lattice, lines, mixing, neardup, outliers, packing, sharding, substrings

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, source=lambda i: "s", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(4)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def sayings(n, seed, vocabulary=40, length=60):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(length))) for _ in range(n)]


def test_words_and_sequences():
    rows = ["a b\x0bc", None, "", "  x y  z", "b", "a b\x0bc "]
    h, n = hashing.word_hashes(pa.array(rows, pa.string()))
    assert n.tolist() == [3, 0, 0, 2, 1, 3]
    assert h[1] == h[5] and h[0] == h[6] and len(set(h.tolist())) == 5
    k1, k2 = hashing.sequence_keys(h, n)
    assert k1[0] == k1[5] and k2[0] == k2[5] and k1[1] == k1[2] and len(set(k1.tolist())) == 4
    s = hashing.sliding(h, 3)
    assert s[0] == s[6] and len(s) == len(h) - 2
    assert hashing.word_hashes(pa.array(rows, pa.string()).slice(4))[1].tolist() == [1, 3]


def test_fingerprints(spark, docs, texts):
    rows = by_id(fingerprints.fingerprint_edits(docs))
    order = sorted(texts, reverse=True)
    exact, estimated = [], []
    for here, there in zip(order, order[1:] + order[:1]):
        text, k = texts[here], len(texts[here]) // 3
        edit = text[:len(text) - k] + texts[there][:k]
        assert rows[here]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert rows[here]["n_chars"] == len(text)
        sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (text.encode().split(), edit.encode().split())]
        exact.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        estimated.append(rows[here]["near_edited"])
        own, after = (fingerprints.from_text(rows[x]["fingerprint"]) for x in (here, there))
        assert rows[here]["near_next"] == fingerprints.likeness(own, after)
    assert np.mean(np.abs(np.array(exact) - estimated)) < 0.1
    plain = by_id(fingerprints.fingerprint(docs))
    assert all(plain[i]["fingerprint"] == rows[i]["fingerprint"] for i in rows)


def test_sketches_merge_and_contain():
    long, short = sayings(1, 1, 5000, 9000)[0], ""
    long = " ".join(f"x{i % 3000}" for i in range(3000))
    short = " ".join(long.split()[500:900])
    a, b, both = fingerprints.sketches(pa.array([long, short, long]))
    assert np.array_equal(a, both) and fingerprints.containment(b, a) == 1
    assert 0.05 < fingerprints.containment(a, b) < 0.25
    assert np.array_equal(fingerprints.merge([a, b]), a)


@pytest.mark.parametrize("n_bits", [None, bits.BLOCK])
def test_substrings_by_brute_force(spark, n_bits):
    base = sayings(60, 2, 30, 80)
    base += [base[3] + " zz " + base[5], base[7][5:], "", None, " ".join(["r"] * 70), base[9], "q " * 9]
    got = by_id(substrings.remove_repeats(frame(spark, base), 8, 3, n_bits))
    first = {}
    split = [WORD.findall(t or "") for t in base]
    for i, w in enumerate(split):
        for j in range(len(w) - 7):
            first.setdefault(tuple(w[j:j + 8]), i)
    for i, w in enumerate(split):
        gone = set()
        for j in range(len(w) - 7):
            if first[tuple(w[j:j + 8])] < i:
                gone |= set(range(j, j + 8))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == (len(w), len(gone), kept)


def test_substrings_of_partitions_shorter_than_a_window(spark):
    texts = [" ".join(f"d{n}w{k}" for k in range(n)) for n in range(61)]
    rows = [(n, t) for n, t in enumerate(texts)] + [(100, "x " + texts[60])]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = by_id(substrings.remove_repeats(docs))
    assert all((got[n]["n_words"], got[n]["n_removed"], got[n]["kept_text"]) == (n, 0, t) for n, t in enumerate(texts))
    assert (got[100]["n_removed"], got[100]["kept_text"]) == (60, "x")


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["menu", "foot", "", " ", f"line {i} {j}"]) for j in range(6)) for i in range(60)] + [None, ""]
    rows = frame(spark, texts, lambda i: [None, "a", "b"][i % 3])
    got = by_id(lines.clean_documents(rows))
    for host in range(3):
        own = [i for i in range(len(texts)) if i % 3 == host]
        n = Counter(x for i in own for x in set((texts[i] or "").split("\n")) if x.strip())
        drop = {x for x, k in n.items() if k > 0.1 * len(own) and k >= 2}
        assert drop
        for i in own:
            want = None if texts[i] is None else "\n".join(x for x in texts[i].split("\n") if x not in drop)
            assert got[i]["text"] == want and got[i]["n_chars"] == (None if want is None else len(want))


def test_the_ratio_alone_decides_on_small_sources(spark):
    # sources of 1 to 49 documents; "line k" stands in the first k documents of each
    where = [(n, i) for n in (1, 2, 4, 5, 15, 26, 49) for i in range(n)]
    texts = ["\n".join([f"own {n} {i}", *(f"line {k}" for k in range(1, 7) if i < k)]) for n, i in where]
    got = by_id(lines.clean_documents(frame(spark, texts, lambda i: f"s{where[i][0]}")))
    for at, (n, i) in enumerate(where):
        gone = {f"line {k}" for k in range(1, 7) if min(k, n) >= 2 and min(k, n) > 0.1 * n}
        assert got[at]["text"] == "\n".join(x for x in texts[at].split("\n") if x not in gone), (n, i)


def test_the_ratio_alone_decides_on_small_hosts(spark):
    where = [(n, i) for n in (1, 2, 4, 15, 26) for i in range(n)]
    rows = [(at, f"http://h{n}/x", "".join(f"<p>line {k}</p>" for k in range(1, 7) if i < k) + f"<p>own {n} {i}</p>") for at, (n, i) in enumerate(where)]
    got = {r["page_id"]: r["text"] for r in lines.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for at, (n, i) in enumerate(where):
        want = [f"line {k}" for k in range(1, 7) if i < k and not (min(k, n) >= 2 and min(k, n) > 0.1 * n)] + [f"own {n} {i}"]
        assert got[at] == "\n".join(want), (n, i)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_different_texts_under_one_id(spark, parts):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "alone in the world with words")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(parts)
    roots = {(r["doc_id"], r["k1"]): r["root"] for r in neardup.classes(docs).collect()}
    assert len(roots) == 5 and sorted(Counter(roots.values()).values()) == [1, 2, 2]
    assert sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()) == sorted([(1, a), (1, b), rows[4]])
    two = docs.where("doc_id = 1")
    assert sorted(r["text"] for r in neardup.keep_one(two).collect()) == [a, b]


def test_chat_by_brute_force(spark):
    rng = random.Random(4)
    talks = {0: [("u", "a")], 1: [("u", "a"), ("v", "b")], 2: [("u", "a"), ("v", "b")], 3: [("u", None), ("v", "")], 4: [("u", ""), (None, "")],
             5: [("u", str(i)) for i in range(700)], 6: [("u", str(i)) for i in range(600)], 7: [("u", "a"), ("v", "c")]}
    rows = [(c, t, r, x) for c, talk in talks.items() for t, (r, x) in enumerate(talk)]
    rows += rows[:3]
    rng.shuffle(rows)
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    left = [c for c in talks if not any(o != c and talks[o][:len(talks[c])] == talks[c] and (len(talks[o]) > len(talks[c]) or o < c) for o in talks)]
    assert sorted({r["conv_id"] for r in got}) == left == [1, 3, 4, 5, 7]
    whole = {c: "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])) for c in left}
    assert whole[1] == "<|u|>\na<|end|>\n<|v|>\nb<|end|>\n" and whole[4] == "<|u|>\n<|end|>\n<||>\n<|end|>\n"
    assert {r["copies"] for r in got if r["conv_id"] == 1} == {2} and len([r for r in got if r["conv_id"] == 5]) == 700


def _jaccard(a, b):
    sa, sb = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
    return len(sa & sb) / len(sa | sb) if sa or sb else 0.0


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 60).astype(float)
    wa[:10] = wb[50:] = 0
    pa_, pb = wa / wa.sum(), wb / wb.sum()
    both = (pa_ > 0) & (pb > 0)
    want = sum(1 / np.maximum(pa_ / pa_[i], pb / pb[i]).sum() for i in np.flatnonzero(both))
    a = neardup.signature(ids[wa > 0], wa[wa > 0], 4000)
    b = neardup.signature(ids[wb > 0], wb[wb > 0], 4000)
    assert abs((a == b).mean() - want) < 0.04
    again = neardup.signature(ids[wa > 0][::-1], 3 * wa[wa > 0][::-1], 4000)
    assert (a == again).mean() == 1  # only the proportions of the weights count


def test_repeats_do_not_part_alike_sets():
    # 396 common shingles and 48 own ones on each side, which repeat: 0.805 by the sets
    rng = np.random.default_rng(12)
    for times in (1, 10, 200, 10**6):
        lost = agree = 0
        for _ in range(150):
            ids = rng.integers(0, 1 << 63, 492).astype(np.uint64)
            n = np.r_[np.ones(396, int), np.full(96, times)]
            a, b = (neardup.signature(ids[own], neardup.weights_of(n[own])) for own in (np.arange(444), np.r_[np.arange(396), np.arange(444, 492)]))
            same = (a == b).reshape(neardup.BANDS, neardup.BAND)
            agree += same.mean() / 150
            lost += not same.all(1).any()
        assert not lost and agree > 0.8 / neardup.HEAVIEST - 0.01, times
    assert (1 - (0.8 / neardup.HEAVIEST) ** neardup.BAND) ** neardup.BANDS < 4e-6


def test_links_of_texts_with_own_repeated_lines(spark):
    # pairs whose common part stands once and whose own sentence is repeated 200 times
    texts = []
    for p in range(60):
        common = " ".join(f"p{p}c{k}" for k in range(396))
        texts += [common + "".join(" " + " ".join(f"p{p}{side}{k}" for k in range(42)) for _ in range(200)) for side in "ab"]
    split = [t.split() for t in texts]
    assert all(0.8 <= _jaccard(split[i], split[i + 1]) < 0.82 for i in range(0, 120, 2))
    got = by_id(neardup.class_table(frame(spark, texts)))
    assert [got[i]["class_id"] for i in range(120)] == [i - i % 2 for i in range(120)]


def test_parities_differ_in_no_more_bits_than_the_sets_in_elements():
    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 200, 3000):
        a = rng.integers(0, 2**32, size, dtype=np.uint64).astype(np.uint32)
        b = np.concatenate([a[: size // 2], rng.integers(0, 2**32, size // 3, dtype=np.uint64).astype(np.uint32)])
        a, b = np.unique(a), np.unique(b)
        bits_ = sum(bin(int(v) & (2**64 - 1)).count("1") for v in neardup.parity(a) ^ neardup.parity(b))
        assert bits_ <= len(np.setxor1d(a, b)) and (bits_ - len(np.setxor1d(a, b))) % 2 == 0
        assert size != 40 or bits_ > 0.8 * len(np.setxor1d(a, b))


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 200))) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:
        for _ in range(3):
            w = t.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    texts += [base[1], base[1] + " ", "", None, "one two", "one two", "one  two three"]
    split = [(t or "").split() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if split[i] == split[j] and (split[i] or texts[i] in ("", None)) or _jaccard(split[i], split[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = by_id(neardup.class_table(frame(spark, texts)))
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    kept = sorted(r["doc_id"] for r in neardup.keep_one(frame(spark, texts)).collect())
    assert kept == sorted(set(root))


def test_no_link_under_a_shared_key_is_lost(spark, monkeypatch):
    signed = neardup._signed
    monkeypatch.setattr(neardup, "_signed", lambda docs: signed(docs).withColumn("keys", F.array(F.lit(7).cast("long"))))
    rng = random.Random(8)
    texts = []
    for c in range(8):  # chains: each text is alike only to its neighbours, and under the one key most are not paired at first
        own = [f"c{c}w{k}" for k in range(400)]
        texts += [" ".join(own[25 * k:25 * k + 200]) for k in range(6)]
    rng.shuffle(texts)
    split = [t.split() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _jaccard(split[i], split[j]) >= 0.75:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(set(root)) == 8
    got = by_id(neardup.classes(frame(spark, texts), 0.75))
    assert [got[i]["class_id"] for i in range(len(texts))] == root


@pytest.mark.parametrize("similarity", [0.5, 0.75, 0.8])
def test_alike_sets_meet_in_their_prefixes(similarity):
    rng = random.Random(3)
    for _ in range(3000):
        x, y = rng.randrange(1, 40), rng.randrange(1, 40)
        common = rng.randrange(0, min(x, y) + 1)
        if common < similarity * (x + y - common):
            continue
        order = rng.sample(range(x + y - common), x + y - common)
        a, b = sorted((sorted(order[:x]), sorted(order[x - common:])), key=len)
        small, large = neardup.prefix_lengths(np.int64(len(a)), similarity)[0], neardup.prefix_lengths(np.int64(len(b)), similarity)[1]
        assert set(a[:small]) & set(b[:large])


def test_a_template_under_one_key_makes_no_pairs(spark):
    # 20,000 texts under one key: 80 shingles of a template and 20 of their own, so alike at 0.67; two have a near copy
    own = spark.range(20_000).select(F.col("id").alias("node"), F.expr("array_union(transform(sequence(1, 80), i -> cast(xxhash64(-i) >> 32 as int)), "
                                     "transform(sequence(1, 20), i -> cast(xxhash64(id, i) >> 32 as int)))").alias("shingles"))
    copies = own.where("node in (5, 17777)").select((F.col("node") + 100_000).alias("node"), F.expr("slice(shingles, 3, 98)").alias("shingles"))
    own = own.unionByName(copies).withColumn("root", F.col("node"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(neardup.PARITY - 1)), lambda i: F.lit(0).cast("long"))  # these rule nothing out
    sets = own.select("node", "shingles", flags.alias("parity"))
    low, high = neardup._meetings(neardup._prefixes(own.withColumn("parity", flags), 0.8))
    assert low.join(high, ["shingle", "side", "i", "j"]).count() < 1000
    none = spark.createDataFrame([], "a long, b long")
    got = neardup._distances(neardup._apart(own.select("node", "root"), none, sets, 0.8), sets).where("common >= 0.8 * every")
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(5, 100_005), (17_777, 117_777)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (20, 21), (21, 1), (5, 5)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in (1, 2, 3, 4, 20, 21)} == {1} and got[9] == got[8] == 8
    assert all(got[k] == 100 for k in range(100, 160)) and all(got[k] == 200 for k in range(200, 241))


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    names = ["b", "a", None, "ä", "Z", "tiny"]
    rows = [(i, names[min(rng.randrange(9), 5)]) for i in range(900)]
    texts = [" ".join(["w"] * (rng.randrange(1, 400) if s != "tiny" else 2)) for _, s in rows] + [None, ""]
    rows += [(900, "a"), (901, "empty")]
    got = by_id(mixing.mix_table(frame(spark, texts, lambda i: rows[i][1])))
    size = Counter()
    for (_, s), t in zip(rows, texts):
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(size.values())), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in full}
        left -= sum(3 * size[s] for s in full)
        open_ -= full
    taken = Counter()
    for (i, s), t in zip(rows, texts):
        r = got[i]
        assert r["size"] == len((t or "").split()) and r["taken"] <= 3 * r["size"] and r["source_size"] == size[s]
        assert r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(2, 0.002 * size[s]) for s in order)
    again = by_id(mixing.mix_table(frame(spark, texts, lambda i: rows[i][1]).repartition(7)))
    assert all(again[i]["taken"] == got[i]["taken"] for i in got)


def test_tilt_is_the_dual_solution(spark):
    cells = spark.createDataFrame([("1a", s, n) for s, n in ((10, 50), (40, 20), (300, 4))], "site string, size long, n long")
    goals = spark.createDataFrame([("1a", 2500, 3300.0)], "site string, source_size long, target double")
    r = mixing.tilts(cells, goals).first()
    assert sum(s * n * min(3, math.exp(r["tilt"] * s / r["mean"])) for s, n in ((10, 50), (40, 20), (300, 4))) == pytest.approx(3300, rel=1e-5)


def test_spelling_sums_all_segmentations():
    pieces = {p: math.log(w) for p, w in {b" ": .1, b" a": .1, b"a": .2, b"b": .1, b"ab": .2, b" ab": .1, b"ba": .1}.items()}

    def every(s):
        return 1.0 if not s else sum(math.exp(pieces[s[:k]]) * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces)

    for word in (b"a", b"abba", b"abab", b"bb"):
        assert lattice.spelling(word, pieces, math.log(.1), 3) == pytest.approx(math.log(every(b" " + word) * .1))


def test_scores_by_all_segmentations(spark):
    rng = random.Random(12)
    known = ["".join(rng.choice("aeinrst") for _ in range(3)) for _ in range(90)] + ["e", "on", "ü", "stern"]
    texts = [" ".join(rng.choice(known) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "neverseen"]
    got = by_id(lattice.score(frame(spark, texts), rounds=2))
    tokens = [(t or "").encode().lower().split() for t in texts]
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in learned for w in tokens[i])

    def cuts(s, pieces):
        if not s:
            yield 1.0, ()
        for k in range(1, len(s) + 1):
            if s[:k] in pieces:
                yield from ((math.exp(pieces[s[:k]]) * p, (s[:k], *rest)) for p, rest in cuts(s[k:], pieces))

    sp, first = lattice._processor(lattice.default_pieces()), Counter({-1: len(c)})
    for w in c:
        first.update(sp.encode(w.decode()))
    pieces, end = lattice.arcs(lattice.default_pieces(), first)
    for _ in range(2):
        weight = Counter()
        for w in c:
            every = list(cuts(b" " + w, pieces))
            for p, own in every:
                for piece in own:
                    weight[piece] += p / sum(q for q, _ in every)
        total = math.log(sum(weight.values()) + lattice.PIECE_COUNT * (len(pieces) + 1) + len(c))
        pieces = {p: math.log(weight[p] + lattice.PIECE_COUNT) - total for p in pieces}
        end = math.log(len(c) + lattice.PIECE_COUNT) - total
    model = lattice.Model(sum(c.values()) + len(learned), len(learned), len(c), sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values()))
    for i, own in enumerate(tokens):
        want = sum(model.score(c[w], math.log(sum(p for p, _ in cuts(b" " + w, pieces))) + end) for w in own) + model.end_score()
        assert got[i]["score"] == pytest.approx(want, rel=1e-6), texts[i]


def test_lattices_of_many_words_equal_those_of_one():
    rng = random.Random(13)
    words = [bytes(rng.choice(b"abc\xc3\xbc") for _ in range(rng.choice([1, 2, 5, 5, 5, 9, 60]))) for _ in range(400)]
    pieces = {bytes([b]): rng.uniform(-9, -5) for b in range(256)} | {p: rng.uniform(-7, -2) for p in (b" a", b"ab", b"abc", b"bca", b"\xc3\xbc", b"cccc", b" ab")}
    many = lattice.Lattices(pieces)
    assert many.spelled(words, -1.5) == pytest.approx([lattice.spelling(w, pieces, -1.5, 4) for w in words])
    want = Counter()
    for w in words:
        want.update(lattice.expected(w, pieces, 4))
    assert many.expected(words) == pytest.approx([want[p] for p in pieces])


@pytest.mark.parametrize("frequent", [20, 200_000])
def test_scores(spark, docs, texts, frequent):
    got = by_id(lattice.score(docs, frequent=frequent))
    learned = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    tokens = {i: t.encode().lower().split() for i, t in texts.items()}
    c = Counter(w for i in learned for w in tokens[i])
    n, v = sum(c.values()) + len(learned), len(c) + 1
    for i, own in tokens.items():
        counts = [c[w] for w in own] + [len(learned)]
        assert got[i]["held_out"] == (i not in learned) and got[i]["train_tokens"] == n
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(counts), sum(k > 0 for k in counts))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((k + .1) / (n + .1 * (v + 1))) for k in counts))
    # words never seen are spelled, which costs more than the base grants them without limit
    held = [i for i in tokens if i not in learned]
    assert sum(got[i]["score"] for i in held) > 1.35 * sum(got[i]["base_score"] for i in held)
    model = lattice.Model(n, len(learned), v - 1, sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values()))
    assert sum(10 ** model.score(k, -1e9) for k in c.values()) + model.spelled * (1 - model.end) + model.end == pytest.approx(1)


def test_token_ids_equal_the_tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder = packing.default_encoder()
    slow = packing.Encoder(public.path("byte_bpe_50k.json"))
    for t in ["", " ", "a", " a b", "a  b", "a\n\nb \nc", "x\t y\n z", "it's  'll we'll\n'ok", "ü ß  q", "日本 語\n字", "<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>\n<|endoftext|>", "a b \n", "12 34,5 !? 6\n7"]:
        want = np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.ids(t) == slow.ids(t) == want, t


def test_packing_round_trip(spark, docs, texts):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    of, bins = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for i, text in texts.items():
        own = sorted(of[i], key=lambda r: r["piece"])
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert b"".join(bytes(r["ids"]) for r in own) == np.asarray(ids, "<u4").tobytes()
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        assert len(own) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in own[1:])
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        assert sum(r["length"] for r in own) <= 1024
    assert len(bins) <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_genetic_steps_keep_every_piece():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 700, 300).tolist()
    a, b = (packing.best_fit(packing.Solution([], []), order, lengths, 1024) for order in (list(range(300)), np.argsort(lengths)[::-1].tolist()))
    child = packing.cross(a, b, lengths, 1024, rng)
    assert sorted(i for own in child.bins for i in own) == list(range(300))
    assert child.fill == [sum(lengths[i] for i in own) for own in child.bins] and max(child.fill) <= 1024
    bin_of, n = packing.evolve(lengths, 1024, [], 1)
    assert n == len(set(bin_of.tolist())) <= min(len(a.bins), len(b.bins)) and n >= -(-sum(lengths) // 1024)


def _stats(text):
    w = WORD.findall(text or "")
    seen = [x for x in (text or "").split("\n") if WORD.search(x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(seen) - len(set(seen)),
            len({i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}))


def test_quality_statistics_and_outliers(spark, texts):
    rng = random.Random(9)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400))) for _ in range(300)]
    symbols = [" ".join(w + "###$$$" for w in t.split()) for t in clean[:20]]
    spaced = [" ".join(t.replace(" ", ""))[:600] for t in clean[20:30]]
    repeats = ["a b a b a b c", "x\nx\n \n\nx y", None, "", "one two three one two three four one two three", *list(texts.values())[:60]]
    every = clean + symbols + spaced + repeats
    got = by_id(outliers.quality_table(frame(spark, every, lang=lambda i: "en" if i < 330 else None)))
    for i, t in enumerate(every):
        r, want = got[i], _stats(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert all(got[i]["kept"] for i in range(300)) and not any(got[i]["kept"] for i in range(300, 320))
    assert not any(got[i]["kept"] for i in range(320, 330))


def test_estimate_is_not_pulled_by_outliers(spark):
    rng = np.random.default_rng(10)
    good = rng.normal(0, 1, (4000, 4)) @ np.diag([1, .5, 2, 1]) + 3
    bad = rng.normal(40, 1, (800, 4))
    rows = [("g", *map(float, v)) for v in np.vstack([good, bad])]
    r = outliers.estimate(spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")).first()
    assert all(abs(r[f"m{i}"] - 3) < 0.15 for i in range(4))
    assert [r["l00"], r["l11"], r["l22"], r["l33"]] == pytest.approx([1, .5, 2, 1], rel=.2)


def _determinant(rows, cover, scale, rng):
    """Smallest covariance determinant over many starts: centre and covariance of the nearest share of the rows."""
    size, best = math.ceil(cover * len(rows)), None
    for start in range(60):
        m, c = np.median(rows, 0), np.diag(np.maximum(np.var(rows, 0), 1e-3)) / 4
        if start:
            few = rows[rng.choice(len(rows), 12, replace=False)]
            m, c = few.mean(0), np.cov(few.T, bias=True)
        for _ in range(30):
            c = c + np.diag(np.where(np.diag(c) < np.square(outliers.FLOORS), np.square(outliers.FLOORS), 0))
            d = np.einsum("ij,jk,ik->i", rows - m, np.linalg.inv(c), rows - m)
            near = rows[np.argsort(d)[:size]]
            m, c = near.mean(0), scale * np.cov(near.T, bias=True)
        c = c + np.diag(np.where(np.diag(c) < np.square(outliers.FLOORS), np.square(outliers.FLOORS), 0))
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    return best[1:]


def _worded(rng, mean, n, repeats=0):
    """A text of n words of about so many letters, the first of them said twice where repeats is above 0."""
    said = ["".join(rng.choice("abcdefghijklmnop") for _ in range(max(1, round(rng.gauss(mean, 1))))) for _ in range(n)]
    return " ".join(said + said[:repeats])


def test_verdicts_are_those_of_a_brute_force_estimate(spark):
    rng = random.Random(12)
    every = [_worded(rng, rng.gauss(9, .3), rng.randrange(150, 300)) for _ in range(220)] + [_worded(rng, rng.uniform(9, 15), 200) for _ in range(30)]
    every += [_worded(rng, rng.gauss(9, .3), 200, round(math.exp(rng.gauss(2.5, .3))) + 3) for _ in range(120)] + [_worded(rng, rng.uniform(5, 9), 200, rng.randrange(4, 90)) for _ in range(20)]
    got = by_id(outliers.quality_table(frame(spark, every)))
    cover, far = outliers.COVER, outliers._chi2_inverse(outliers.LIMIT, 4)
    scale = cover / outliers._chi2(outliers._chi2_inverse(cover, 4), 6)
    decided = []
    for repeats in (False, True):
        own = [r for r in got.values() if (r["n_repeat_words"] > 0) == repeats]
        rows = np.array([[math.log(r["word_chars"] / r["n_words"]), 0, 0, math.log(r["n_repeat_words"] / r["n_words"]) if repeats else 0] for r in own])
        m, c = _determinant(rows, cover, scale, np.random.default_rng(1))
        d = np.einsum("ij,jk,ik->i", rows - m, np.linalg.inv(c), rows - m)
        for r, distance in zip(own, d):
            if not 0.85 * far < distance < 1.15 * far:  # nearest shares may differ by a row or two of equal bins
                decided.append(distance > far)
                assert r["kept"] == (distance < far), (r, distance)
    assert len(decided) > 370 and 15 < sum(decided) < 60


def test_the_spread_of_a_group_decides(spark):
    def verdict(spread):
        rng = random.Random(13)
        texts = [_worded(rng, 9 + spread * rng.gauss(0, 1), 200) for _ in range(150)] + [_worded(rng, 12.2, 200)]
        return by_id(outliers.quality_table(frame(spark, texts)))[150]["kept"]

    assert not verdict(.3) and verdict(1.2)


def test_values_that_few_documents_have_are_judged_among_these(spark):
    rng = random.Random(14)
    plain = [_worded(rng, 9 + .3 * rng.gauss(0, 1), 200) for _ in range(200)]
    said = [_worded(rng, 9 + .3 * rng.gauss(0, 1), 200, rng.randrange(5, 15)) for _ in range(60)]
    marked = [t + " #$%&|" * 20 for t in plain[:5]]
    got = by_id(outliers.quality_table(frame(spark, plain + said + marked)))
    assert all(got[i]["kept"] for i in range(260)) and not any(got[i]["kept"] for i in range(260, 265))


def test_shards(spark, docs, texts):
    more = docs.unionByName(docs.limit(20)).unionByName(docs.where("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = sharding.shard_table(more, 4).collect()
    of = {**texts, **{i + 1000: texts[i] for i in range(30)}}
    assert len(rows) == more.count()
    size, slots, where = Counter(), {}, {}
    for r in rows:
        t = of[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert where.setdefault(t, r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) <= 1.02 * min(size.values())


def test_a_group_above_a_shard_is_split(spark):
    rows = sharding.shard_table(frame(spark, ["same text"] * 400 + sayings(200, 11)), 8).collect()
    n = Counter(r["shard"] for r in rows)
    assert len(rows) == 600 and max(n.values()) <= 1.35 * 600 / 8
