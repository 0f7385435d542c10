"""Source divergence, line rules and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from worklens.llm import divergence, line_rules, runs

DOCS = "doc_id long, text string, lang string, source string"
#: Columns whose names the operators use themselves.
CLASH = DOCS + ", term string, count long, host string, digest string, words array<string>, lines string, kept int, value long, n_runs string, nth int"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- op11 ---


def audited(rows, min_docs, top):
    held, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        held[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        others = [s for x, s in groups if x == lang]

        def shares(count):
            of = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // of for t in kept}

        p = {s: shares(held[lang, s]) for s in others}
        q = shares(sum((held[lang, s] for s in others), Counter()))
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in others if s != source]
        terms = [(t, p[source][t] - q[t]) for t in kept if held[lang, source][t] and p[source][t] > q[t]]
        for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def documents(rng, n):
    words = ["a", "Zebra", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 9, "日本語" * 7, "x" * 300, "ÀB", "b7c", "don't"]
    words += ["".join(rng.choice("abC") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "s3", "s4", "", None])
        text = rng.choice([None, "", "  ", "1 2 3", " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))] + [rng.choice([" ", "\n", "\x00", "-", ". "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(6)])
        rows.append((i, text, lang, source))
    return rows + rows[:5] + [(n, " ".join(words[:20]) * 400, "en", "s1"), (None, "only words here", "xx", "lone")]


@pytest.mark.parametrize(("min_docs", "tile", "tile_terms"), [(3, 256, 8192), (5, 2, 7), (1000, 2, 7)])
def test_audit_equals_brute_force(spark, min_docs, tile, tile_terms):
    rows = documents(random.Random(min_docs), 150)
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3), min_docs, 6, tile, tile_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, min_docs, 6)


def test_blocks_do_not_change_counts(monkeypatch):
    rng = random.Random(2)
    texts = [t for _, t, _, _ in documents(rng, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    whole = pa.concat_arrays([b["text"].combine_chunks() for b in divergence._blocks(iter([batch, batch]))])
    monkeypatch.setattr(divergence, "BLOCK", 500)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 7)
    parts = [b["text"].combine_chunks() for b in divergence._blocks(iter([batch, batch]))]
    assert len(parts) > 20 and max(map(len, parts)) <= 7
    assert pa.concat_arrays(parts).to_pylist() == whole.to_pylist() == texts * 2

    def counted(some):
        out = Counter(), Counter()
        for part in some:
            for g, term, n, rows in divergence.count_block(part, np.zeros(len(part), np.int64)):
                assert not g.any()
                for t, a, b in zip(term.to_pylist(), n.tolist(), rows.tolist(), strict=True):
                    out[0][t] += a
                    out[1][t] += b
        return out

    assert counted(parts) == counted([whole])
    assert max(map(len, counted([whole])[0])) == 300


def test_audit_of_edges(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "same words", "en", s) for i, s in enumerate("aabc")]
    wide = spark.createDataFrame([(*r, "t", 1, "h", "d", ["w"], "l", 0, 9, "n", 4) for r in rows], CLASH)
    assert sorted(map(tuple, divergence.audit(wide, 2).collect())) == audited(rows, 2, 50)


# --- op12 ---


def ruled(rows, limit, left):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    holders = defaultdict(set)

    def lines(text):
        for line in (text or "").split("\n"):
            if words := split.findall(line):
                yield line, re.sub("[0-9]+", "0", lower(" ".join(words))), len(words)

    for _, text, _, source in rows:
        for _, normal, _ in lines(text):
            holders[source or "", normal].add(text)
    out = []
    for doc_id, text, _, source in rows:
        words = split.findall(text or "")
        at = defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        repeated = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
        seen = [line for line, _, _ in lines(text)]
        common = sum(n for _, normal, n in lines(text) if len(holders[source or "", normal]) > limit)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        measures = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(seen) - len(set(seen)), len(repeated)
        out.append((doc_id, *measures, failed, not failed and 100 * (len(words) - common) >= left * len(words), common))
    return sorted(out, key=repr)


def lined(rng, n):
    word = lambda: rng.choice(["a", "b", "cc", "Dé", "#x", "7", "日本", "e|f", "\x1cq\x85", "g$"])
    common = [" ".join(word() for _ in range(12)) for _ in range(6)]
    rows = []
    for i in range(n):
        own = [" ".join(word() + str(rng.random()) * (rng.random() < 0.8) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(0, 9))]
        shared = [rng.choice([str.upper, str.title, lambda x: "\t" + x + "  ", lambda x: x.replace("7", "123")])(rng.choice(common)) for _ in range(rng.randint(0, 14))]
        text = rng.choice(["\n", "\n \r\n", "\n\n"]).join(rng.sample(own + shared, len(own + shared)))
        rows.append((i, rng.choice([None, "", " \x0b\n"]) if rng.random() < 0.1 else text, "en", rng.choice(["h", "h", "k", None])))
    return rows + rows[:3] * 2 + [(n + i, rows[4][1], "en", "k") for i in range(30)]


def test_line_rules_equal_brute_force(spark):
    rows = lined(random.Random(1), 160)
    got = line_rules.judge(spark.createDataFrame(rows, DOCS).repartition(5), limit=9)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == ruled(rows, 9, line_rules.LEFT)
    assert {(r[6], r[7]) for r in got} == {(True, False), (False, False), (False, True)}


def test_copies_make_no_line_common_and_ties_stay(spark):
    clean = "\n".join(" ".join(f"{chr(97 + i)}{k}x{chr(107 + i)}" for k in range(8)) for i in range(9))
    copies = [(i, clean, "en", "h") for i in range(60)]
    at_limit = [(100 + i, f"the same first line of all\n{' '.join(chr(97 + (i * k) % 26) * (k + 1) for k in range(60))}", "en", "h") for i in range(20)]
    out = line_rules.judge(spark.createDataFrame(copies + at_limit, DOCS)).collect()
    assert all(r["kept"] and r["n_common_words"] == 0 for r in out if r["doc_id"] < 100)
    assert all(r["n_common_words"] == 0 for r in out)


def test_line_rules_of_edges(spark):
    assert line_rules.judge(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, None), (1, "a b " * 40_000, "en", "s"), (1, "a b " * 40_000, "en", "s"), (2, "x", "en", None)]
    wide = spark.createDataFrame([(*r, "t", 1, "h", "d", ["w"], "l", 0, 9, "n", 4) for r in rows], CLASH)
    assert sorted(map(tuple, line_rules.judge(wide).collect()), key=repr) == ruled(rows, 20, line_rules.LEFT)


def test_line_rules_run_without_python(spark):
    plan = line_rules.judge(spark.createDataFrame(lined(random.Random(4), 5), DOCS).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- op13 ---


def runs_by_definition(words, least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def lyndon_by_definition(w):
    return [max(n for n in range(1, len(w) - i + 1) if all(w[i : i + n] < w[i + k : i + n] for k in range(1, n))) for i in range(len(w))]


def test_lyndon_lengths_of_both_orders():
    rng = random.Random(5)
    for _ in range(400):
        w = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(1, 24))]
        for x in (w, [9 - c for c in w]):
            assert runs.lyndon_lengths(np.array([-1, *x]))[1:].tolist() == lyndon_by_definition(x)


def periodic(rng):
    letters = rng.choice(["a", "ab", "abc", "abcdefghij"])
    words = [rng.choice(letters) * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 90))]
    if words and rng.random() < 0.6:
        a, p = rng.randrange(len(words)), rng.randint(1, 9)
        words = [words[i if i < a else a + (i - a) % min(p, len(words) - a)] for i in range(len(words))]
    return rng.choice([" ", "\n", " \t\x0b"]).join(words)


def digested(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_by_definition(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_equal_the_definition(spark):
    rng = random.Random(8)
    rows = [(i, periodic(rng), "en", "s") for i in range(260)]
    rows += [(i, periodic(rng), "en", "s") for i in range(1000, 12000) if zlib.crc32(str(i).encode()) % 10 == 0][:80]
    rows += [(300, None, None, None), (301, "", "", ""), (302, "  \n", "", ""), (None, "x " * 30, None, None), (None, None, None, None), *rows[:4]]
    df = spark.createDataFrame([(*r, "t", 1, "h", "d", ["w"], "l", 0, 9, "n", 4) for r in rows], CLASH).repartition(3)
    got = runs.run_digests(df, plant=True)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((digested(r[0], r[1]) for r in rows), key=repr)
    found = [(r[0], *x) for r in rows for x in runs_by_definition((r[1] or "").encode().split())]
    assert sorted(map(tuple, runs.periodic_runs(df).collect()), key=repr) == sorted(found, key=repr)


def test_collapsing_leaves_other_texts_alone(spark):
    rows = [(1, "one  two\tthree"), (2, "go " * 20 + "on"), (3, None), (4, "")]
    out = dict((r[0], r[1:]) for r in runs.collapse_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == {1: ("one  two\tthree", 0), 2: ("go on", 1), 3: (None, 0), 4: ("", 0)}
    assert runs.run_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_of_a_very_long_text():
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 1000, 70_000)
    word = np.concatenate((np.full(50_000, 7), unit, unit, unit[:10], rng.integers(0, 3, 5_000), np.arange(2000, 2400)))
    start, length, period = runs.runs_of(word, np.zeros(len(word), np.int64))
    found = dict(zip(period.tolist(), zip(start.tolist(), length.tolist(), strict=True), strict=False))
    assert found[70_000][1] >= 140_010 and (0, 50_000 + int((unit[:1] == 7).sum()), 1) in list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        assert (word[s : s + n - q] == word[s + q : s + n]).all()
        assert s == 0 or word[s - 1] != word[s - 1 + q]
        assert s + n == len(word) or word[s + n] != word[s + n - q]
