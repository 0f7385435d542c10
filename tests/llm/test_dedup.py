"""Exact, SimHash and substring dedup and the embedding index against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from worklens.llm import exact_dedup, pivots, simhash, substring
from worklens.llm.common import connected_components

DOCS = "doc_id long, text string, lang string"
#: Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, key long, norm string, fp long, kept boolean, bucket int, score double, n_removed int, __id long, component_id long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [words(rng, rng.randint(3, 60)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(100 + i, texts[i % 7].upper()) for i in range(40)]
    out += [(200 + i, texts[1] + " é" * (i % 3)) for i in range(10)]
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "É"), (304, "é"), (305, words(rng, 30000)), (306, "x"), (306, "x"), (None, texts[2]), (None, None)]
    return out


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    want = roots({n for e in edges for n in e}, edges)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("capacity", [1, 4, 4096])
def test_exact_dedup(spark, rows, capacity):
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    got = sorted(map(tuple, exact_dedup.exact_dedup(df, capacity).drop("bucket").collect()), key=str)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_directory_splits_overfull_buckets(spark):
    df = spark.createDataFrame([(i, f"text {i}", "en") for i in range(500)], DOCS)
    index = exact_dedup.entries(df)
    held = index.join(exact_dedup.directory(index, 20), "cell").groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in held) == 500
    assert max(r["count"] for r in held) <= 20 and len(held) > 25
    assert all(r["bucket"] >> r["depth"] == 1 for r in held)
    assert {r["depth"] for r in exact_dedup.directory(index, 1000).collect()} == {0}


def test_exact_keep(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, None) for i, t in rows], CLASH)
    kept = exact_dedup.keep_documents(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len({lower(t) for _, t in got}) == len(got) == len({lower(t) for _, t in rows})
    assert dict(got)[306] == "x"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_groups(spark, rows):
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    got = sorted(map(tuple, simhash.simhash_groups(df).collect()), key=str)
    fp = {t: brute_fingerprint(t) for _, t in rows}
    values = sorted(set(fp.values()))
    root = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[fp[t]]] = min(i, least.get(root[fp[t]], i))
    assert got == sorted([(i, f"{fp[t]:016x}", least[root[fp[t]]]) for i, t in rows], key=str)


@pytest.mark.parametrize("pairs_up_to", [0, 3, 64])
def test_simhash_links_join_all_that_differ_in_two_bits(spark, pairs_up_to):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), pairs_up_to).collect()
    far = [(a, b) for a, b in got if ((a ^ b) & (2**64 - 1)).bit_count() > 2]
    assert pairs_up_to != 64 or not far
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert roots(signed, [tuple(r) for r in got]) == want


def test_simhash_keep(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, None) for i, t in rows], CLASH)
    kept = simhash.keep_documents(df)
    assert kept.columns == df.columns
    groups = {r.component_id for r in simhash.simhash_groups(df).where("doc_id IS NOT NULL").collect()}
    ids = [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == sorted(groups) and kept.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("block", [5, 2048])
def test_byte_links_join_all_within_seven_bits(spark, block):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in sorted(fps):
        for b in rng.sample(range(64), rng.randint(3, 9)):
            f ^= 1 << b
        fps.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in sorted(fps)]
    got = simhash.byte_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 7, block).collect()
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 7])
    assert roots(signed, [tuple(r) for r in got]) == want


@pytest.mark.parametrize("texts", [4, 256])
def test_stage_keeps_one_of_near_copies(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (texts,))
    rng = random.Random(8)
    rows = []
    for i in range(30):
        base = words(rng, rng.choice([20, 80, 200])).split()
        for k in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for at in rng.sample(range(len(copy)), len(copy) * (k > 0) // rng.choice([20, 40, 80])):
                copy[at] = "zz"
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, "Of three words"), (901, "of  three words"), (902, ""), (903, " "), (None, rows[0][1]), (7, rows[7][1])]
    sets = []
    for _, t in rows:
        w = lower(t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any((simhash.fingerprint(rows[a][1].encode(), 5) ^ simhash.fingerprint(rows[b][1].encode(), 5)).bit_count() > 7 for a, b in pairs)
    root = roots(range(len(rows)), pairs)
    want = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            want[root[k]] = min(i, want.get(root[k], i))
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([*want.values(), None], key=str)


def brute_repeats(rows, min_words=substring.MIN_WORDS, long=substring.LONG):
    found, gone = {}, {}
    for i, t in rows:
        sentences = [s.split() for line in substring.lines_of(t.lower()) for s in line]
        real = [k for k, s in enumerate(sentences) if s]
        runs = set()
        for at in range(len(real)):
            for step in (1, -1):
                j, n = at, 0
                while 0 <= j < len(real):
                    n += len(sentences[real[j]])
                    if n >= min_words and (j != at or n >= long):
                        runs.add((min(at, j), max(at, j)))
                        break
                    j += step
        for a, b in runs:
            found.setdefault(tuple(tuple(sentences[k]) for k in real[a : b + 1]), set()).add((i, real[a], real[b]))
    for places in found.values():
        for i, a, b in sorted(places)[1:]:
            gone.setdefault(i, set()).update(range(a, b + 1))
    return gone


def sentences(rng, n):
    return " ".join(words(rng, rng.randint(1, 18)).capitalize() + rng.choice(".!?") for _ in range(n))


def test_substring_removal(spark):
    rng = random.Random(9)
    passage = [sentences(rng, 6) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [sentences(rng, rng.randint(1, 8)) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), passage[i % 9 // 3])
        rows.append((i, rng.choice(["\n", " ", "\n\n"]).join(parts)))
    rows += [(70, rows[0][1]), (71, passage[0].upper()), (72, words(rng, 45) + "."), (73, rows[-1][1]), (74, ""), (75, "."), (76, words(rng, 20000))]
    rows += [(77, passage[1] + " " + passage[1])]
    df = spark.createDataFrame([(i, t, "en") for i, t in [*rows, (78, None), (None, passage[0])]], DOCS)
    got = {r.doc_id: r for r in substring.remove_repeats(df).collect()}
    gone = brute_repeats(rows)
    assert gone and len(got) == len(rows) + 2
    for i, t in rows:
        assert got[i].text == (substring.without(t, gone[i]) if i in gone else t), i
        assert got[i].n_removed == len(gone.get(i, ()))
    assert got[78].text is None and got[None].text == passage[0]
    assert got[70].text == "" and got[71].text == ""


def test_substring_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(2)
    passage = sentences(rng, 8)
    rows = [(i, sentences(rng, 3) + " " + passage + " " + sentences(rng, 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    once = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    monkeypatch.setattr(substring, "BUCKET_DOCS", 2)
    monkeypatch.setattr(substring, "BLOCK", 1)
    assert {r.doc_id: r.text for r in substring.remove_repeats(df).collect()} == once
    assert passage in once[0] and not any(passage in t for i, t in once.items() if i)


def test_clean_documents_keeps_columns_and_counts_anew(spark):
    rng = random.Random(2)
    t = sentences(rng, 9)
    df = spark.createDataFrame([(1, t, 7, 1, 2), (2, t, 8, 1, 2), (3, "Short.", 9, 1, 2)], "doc_id long, text string, n_chars long, n_removed int, bucket int")
    out = {r.doc_id: r for r in substring.clean_documents(df).collect()}
    assert substring.clean_documents(df).columns == df.columns
    assert (out[1].n_chars, out[2].n_chars, out[3].n_chars) == (7, 0, 9)


def vectors(rng):
    base = rng.normal(size=(60, 24))
    near = [b + rng.normal(size=24) * s for b, s in zip(base[:20], np.linspace(0.02, 0.6, 20))]
    hot = base[0] + rng.normal(size=(150, 24)) * 0.05
    return np.concatenate([base, near, hot, base[3:6], base[3:6] * 2]).astype(np.float32)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors(spark, kind, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 40)  # blocks of a long list meet in pairs
    x = vectors(np.random.default_rng(4))
    rows = [(10 + i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 24, 0), (4, [1.0] * 23 + [None], 0), (5, [1.0] * 23 + [float("nan")], 0), (6, [float("inf")] * 24, 0), (7, [1.0, 0.0], 0), (None, [1.0] * 5, 0)]
    df = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>, rid int")
    got = {r.vec_id: r for r in pivots.near_dedup(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= pivots.MIN_COSINE
    np.fill_diagonal(link, False)
    assert sum(r.n_links for r in got.values()) >= 0.97 * link.sum()
    assert all(got[10 + i].n_links <= n for i, n in enumerate(link.sum(axis=1)))
    root = roots(range(len(x)), list(zip(*map(list, np.nonzero(link)))))
    assert sum(got[10 + i].component_id == 10 + root[i] for i in range(len(x))) >= 0.97 * len(x)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    for fn in (exact_dedup.exact_dedup, exact_dedup.keep_documents, simhash.simhash_groups, simhash.keep_documents, substring.remove_repeats, substring.clean_documents):
        assert fn(docs).count() == 0
    assert pivots.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
