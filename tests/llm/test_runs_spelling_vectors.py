"""Periodic runs, spelling variants and vector links against plain rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quernlog.llm import epsilon_grid, periodic_runs, queries, spelling_variants


def brute_runs(words):
    """All runs (start, length, period), from their definition."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and (i, length) not in out:
                out[i, length] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, count, most):
    r = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < r.randint(0, most):
            root = [r.choice("abc") * r.randint(1, 2) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13, 40, 90]))]
            words += (root * r.randint(1, 9))[: r.randint(1, most)] + [r.choice("abcxyz")] * r.randint(0, 2)
        yield " ".join(words)


@pytest.mark.parametrize("tile", [64, 1 << 13])
def test_runs_equal_their_definition(spark, tile):
    texts = [*periodic_texts(1, 60, 900), "a " * 3000, "a b " * 777 + "a", "x", "", " \t", None, "aa " * 5, "aa " * 6, "q a b c d " * 4]
    texts += [" ".join(map(str, [*range(500), *range(500)])), " ".join(map(str, list(range(700)) * 5)) + " 0 1 2"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in periodic_runs.collapse(docs, tile=tile).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate([*texts, texts[0]]):
        words = (t or "").split()
        want = brute_runs(words)
        assert [tuple(r) for r in got[i].runs] == want, i
        assert got[i].collapsed == brute_collapsed(words, want), i


def test_tiles_cover_their_octave():
    for n in (1, 100, 5000, 40_000):
        for octave in (1, 8, 256):
            found = periodic_runs.tiles(n, octave, 128)
            assert found[0][0] == 0 and found[-1][1] == n and all(b[0] < a[1] for a, b in zip(found, found[1:]))


def test_periodic_runs_on_odd_rows(spark, table, odd_rows):
    got = periodic_runs.collapse(table(odd_rows), keep=("doc_id", "copy")).collect()
    assert len(got) == len(odd_rows)
    texts = {}
    for i, t, _, _ in odd_rows:
        texts.setdefault(i, []).append(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    for r in got:
        if not r.runs:
            assert r.collapsed in texts[r.doc_id]
    assert [r.collapsed for r in got if r.doc_id == 12] == ["the"]
    assert periodic_runs.collapse(table([])).collect() == []


def test_query_of_runs(spark, tmp_path):
    texts = [*periodic_texts(5, 40, 300), None, "", *(" ".join(f"w{k}" for k in range(n)) for n in range(1, 90))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for i, t in enumerate(texts):
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, changed = g % n, changed + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = sorted(brute_runs(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best), i
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()
    assert changed > 3


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_variants_equal_the_plain_rule(spark):
    r = random.Random(4)
    words = set()
    while len(words) < 400:
        w = "".join(r.choice("abcdé") for _ in range(r.randint(6, 9)))
        words.add(w)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", r.choice("abcdéÿ"), w[k] + r.choice("abcdéÿ")]) + w[k + 1 :]
            words.add(w)
    words |= {"a" * k for k in range(1, 14)} | {"abcabcabc", "bcabcabca", "cabcabcab", "1b", "x", "aXc"}
    counts = {w: int(5 ** (r.random() * 6)) + 1 for w in sorted(words)}
    rows = spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, root string, kind int")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling_variants.variants(rows).collect()}
    assert got == brute_variants(counts) and sum(v[0] is not None for v in got.values()) > 50


def test_words_and_their_counts(spark, table, odd_rows):
    docs = table([*odd_rows, (50, "Ébène ébène ÀÉÿ×÷ STRASSE straße", "fr", "s")])
    found = [x.word for x in spelling_variants.occurrences(docs).collect()]
    assert {"Ébène", "ébène", "ÀÉÿ×÷", "strasse", "straße", "x" * 60000} <= set(found) and found.count("the") >= 6
    counted = spelling_variants.counted(spelling_variants.occurrences(docs), length=3, count=2)
    assert all(x.n >= 2 and len(x.word) >= 3 for x in counted.collect())
    assert spelling_variants.variants(spelling_variants.counted(spelling_variants.occurrences(table([])))).collect() == []
    assert len(spelling_variants.variants(counted).collect()) == counted.count()


def test_query_of_variants(spark, tmp_path):
    r = random.Random(2)
    stems = ["".join(r.choice("abcdefgé") for _ in range(r.randint(6, 8))) for _ in range(12)]
    texts = [" ".join(r.choice(stems).capitalize() for _ in range(400)) for _ in range(40)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for i, t in enumerate(texts):
        for w in "".join(c.lower() if c.isascii() else c for c in t or "").split():
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in queries.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute_variants(counts) and any(v[0] for v in got.values())


def brute_links(rows, cosine):
    links = {k: set() for k in range(len(rows))}
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for x, k in enumerate(good):
        for m in good[:x]:
            a, b = (np.array(rows[i][1], float) for i in (k, m))
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[k].add(m)
                links[m].add(k)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out.append((i, len(links[k]), min(ids, default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_equal_all_pairs(spark, kind, monkeypatch):
    r = np.random.default_rng(3)
    rows = []
    for size, count in ((24, 260), (5, 60), (1, 6), (40, 3)):
        centres = r.normal(size=(count // 6 + 1, size))
        for k in range(count):
            v = centres[k % len(centres)] + r.normal(size=size) * r.choice([0.02, 0.2, 0.4, 1.0])
            rows.append([float(np.float32(x)) for x in v * r.choice([1.0, 7.0, 1e-3])])
    rows += [rows[0], rows[0], rows[3], None, [], [0.0] * 24, [float("nan")] + rows[1][1:], [None] + rows[1][1:], [float("inf")] + rows[1][1:]]
    rows += [[-0.0] + rows[2][1:], [0.0] + rows[2][1:], [1e30] * 24, [2e30] * 24]
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(None, rows[5][1]), (7, rows[9][1]), (None, None)]
    table = spark.createDataFrame([(i, v, i, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, component_id long, node int").repartition(3)
    monkeypatch.setattr(epsilon_grid, "LEAF", 16)
    monkeypatch.setattr(epsilon_grid, "INTERVAL_ROWS", 8)
    got = sorted([tuple(x) for x in epsilon_grid.linked(table, 0.95).collect()], key=str)
    assert got == brute_links(rows, 0.95)


def test_links_of_little(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert epsilon_grid.linked(empty).collect() == []
    bad = spark.createDataFrame([(1, None), (2, [0.0]), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, epsilon_grid.linked(bad).collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]
    one = spark.createDataFrame([(3, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, epsilon_grid.linked(one).collect())) == [(2, 1, 2), (3, 1, 2)]


def test_tree_descent_keeps_every_near_pair(spark):
    r = np.random.default_rng(1)
    low = r.normal(size=(70, epsilon_grid.AXES)) * 0.3
    high = low + r.random(size=low.shape) * 0.05
    names = [c for k in range(epsilon_grid.AXES) for c in (f"l{k} double", f"h{k} double")]
    rows = [(i, 3, 3 + i % 2, *(float(x) for k in range(epsilon_grid.AXES) for x in (low[i, k], high[i, k]))) for i in range(70)]
    table = spark.createDataFrame(rows, "interval long, least int, most int, " + ", ".join(names))
    got = {(p.a, p.b) for p in epsilon_grid.interval_pairs(table, 69, 1.0).collect()}
    gap = np.maximum(0, np.maximum(low[:, None] - high[None], low[None] - high[:, None]))
    want = {(i, j) for i in range(70) for j in range(i, 70) if (gap[i, j] ** 2).sum() <= 1.0}
    assert got == want and 70 < len(got) < 2000
