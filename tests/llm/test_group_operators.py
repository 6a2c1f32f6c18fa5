"""Operators that compare or order documents, against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quernlog.llm import components, fair_mixing, line_templates, ngram_jaccard, order_minhash

WORD = r"[^\x20\x09-\x0D]+"


def brute_groups(rows, size, percent):
    """(doc_id, n, component) of rows of one id each, by all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}) if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def edited(text, r, changes):
    w = text.split(" ")
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_groups(table, prose, size, percent):
    r = random.Random(size)
    rows = [(i, prose(i, r.choice([1, 2, 3, 4, 30, 90]))) for i in range(60)]
    base = prose(999, 150)
    rows += [(100 + i, edited(base, r, r.choice([0, 1, 2, 3, 5, 8, 12]))) for i in range(80)]  # its base need not be there
    chain, t = [], prose(777, 100)
    for i in range(15):
        t = edited(t, r, 2)
        chain.append((200 + i, t))
    rows += chain + [(300, None), (301, ""), (302, " \n"), (303, "One"), (304, "one"), (305, base.upper().swapcase())]
    r.shuffle(rows)
    got = ngram_jaccard.groups(table([(i, t, None, None) for i, t in rows]), size, percent)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute_groups(rows, size, percent)


def test_jaccard_finds_links_beside_the_hub(table):
    """Two pairs with common rare shingles whose hub links with neither."""
    words = [f"w{k}" for k in range(40)]
    a = words
    b = words[:38] + ["p", "q"]
    c = words[:10] + [f"c{k}" for k in range(28)]
    rows = [(1, " ".join(c)), (2, " ".join(a)), (3, " ".join(b)), (4, " ".join(words[:9] + [f"d{k}" for k in range(30)]))]
    got = ngram_jaccard.groups(table([(i, t, None, None) for i, t in rows]), 3, 80)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute_groups(rows, 3, 80)


def test_jaccard_on_odd_rows(table, odd_rows):
    rows = ngram_jaccard.groups(table(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    found = collections.Counter((x.doc_id, x.component_id) for x in rows)
    assert found[5, 1] == 1 and found[6, 6] == 2 and found[7, 1] == 1 and found[7, 7] == 1 and found[3, 3] == 1 and found[2, 2] == 1
    assert ngram_jaccard.groups(table([])).count() == 0
    kept = ngram_jaccard.one_of_each(table(odd_rows))
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[5] == 0 and ids[6] == 1 and ids[2] == ids[3] == 1 and ids[None] == 2
    assert kept.columns == table([]).columns


def test_suffix_bound_never_exceeds_the_difference():
    import numpy as np

    r = random.Random(1)
    for _ in range(300):
        span = r.choice([60, 600])
        a, b = (np.array(sorted(r.sample(range(span), r.randrange(1, span * 2 // 3))), np.uint64) for _ in range(2))
        assert ngram_jaccard._suffix_bound(a, b, 2) <= len(set(a.tolist()) ^ set(b.tolist()))
        if len(a) and len(b):  # maps of any two sizes
            assert ngram_jaccard.differing(ngram_jaccard.parity_map(a), ngram_jaccard.parity_map(b)) <= len(set(a.tolist()) ^ set(b.tolist()))
        for percent in (50, 80, 90):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert ngram_jaccard.linked(a, b, percent) == (100 * both >= percent * (len(a) + len(b) - both))


def test_components_of_paths_and_stars(spark):
    r = random.Random(2)
    path = list(range(100, 160))
    r.shuffle(path)
    links = list(zip(path, path[1:])) + [(500, k) for k in range(1, 30)] + [(900, 900)] + [(901, 902), (902, 901)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[k] for k in path} == {100} and {got[k] for k in (500, 1, 29)} == {1} and got[900] == 900 and got[902] == 901
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_order_minhash(table, prose):
    rows = [(3 * i, prose(i, 20 + 7 * i)) for i in range(40)] + [(500, ""), (501, None), (502, "ab")]
    out = {r.doc_id: r for r in order_minhash.edited_pairs(table([(i, t, None, None) for i, t in rows])).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    for at, i in enumerate(ids):
        t, following = texts[i], texts[ids[(at + 1) % len(ids)]]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= out[i].near_next <= 1 and 0 <= out[i].near_edited <= 1
    for i in range(5, 40):
        assert out[3 * i].near_edited > out[3 * i].near_next


def test_order_minhash_sees_order_and_number(spark):
    words = [f"w{k}" for k in range(400)]
    turned = words[200:] + words[:200]
    mixed = [x for k in range(0, 400, 4) for x in (*words[400 - k - 4 : 400 - k],)]
    rows = [(1, " ".join(words), " ".join(words)), (2, " ".join(words), " ".join(turned)), (3, " ".join(words), " ".join(mixed)), (4, "a a a a", "a a"), (5, " ".join(words), "")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    out = {r.k: r.x for r in df.select("k", order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b"))).alias("x")).collect()}
    assert out[1] == 1.0 and out[3] < out[2] < 1.0 and out[4] < 1.0 and out[5] == 0.0


def test_order_minhash_fingerprint_by_hand(spark):
    """Tuples as the expressions give them, from the k-mer hashes Spark gives."""
    text = "a b a b a c b a b d a b"
    tokens = text.split(" ")
    df = spark.createDataFrame([(text,)], "t string")
    hashes = df.select(F.transform(F.split("t", " "), lambda x, i: F.xxhash64(x, F.get(F.split("t", " "), i + 1)))).first()[0]
    assert len(hashes) == len(tokens)
    low = [h & ((1 << 36) - 1) for h in hashes]
    seen, items = collections.Counter(), []
    for place, h in enumerate(low):
        number = seen[h]
        seen[h] += 1
        if number:
            h = spark.range(1).select(F.xxhash64(F.lit(h).cast("long"), F.lit(number).cast("int"))).first()[0] & ((1 << 36) - 1)
        items.append((h >> 30, h, place))
    want = []
    for b in sorted({x[0] for x in items}):
        picked = sorted(sorted(x for x in items if x[0] == b)[:2], key=lambda x: x[2])
        value = spark.range(1).select(F.xxhash64(F.array(*[F.lit(x[1]).cast("long") for x in picked]))).first()[0]
        want.append((b << 24) | (value & ((1 << 24) - 1)))
    assert df.select(order_minhash.fingerprint(F.col("t"))).first()[0] == want


def test_order_minhash_of_texts_without_blanks(table):
    r = random.Random(3)
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(400)) for _ in range(4)] + ["\n".join(f"w{r.randrange(500)}" for _ in range(300))]
    for row in order_minhash.edited_pairs(table([(i, t, None, None) for i, t in enumerate(texts)])).collect():
        assert row.near_edited > max(0.03, row.near_next)


def test_order_minhash_on_odd_rows(table, odd_rows):
    rows = order_minhash.edited_pairs(table(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    same = [r.fingerprint for r in rows if r.doc_id in (1, 5)]
    assert same[0] == same[1] and all(r.near_next is None for r in rows if r.doc_id is None)
    assert order_minhash.edited_pairs(table([])).count() == 0
    alone = order_minhash.edited_pairs(table([(7, "one two three", None, None)])).first()
    assert alone.near_next == 1.0


def brute_mix(rows, weights, percent, passes):
    """The mix of rows (doc_id, size, source) of one id each, by one sorted list."""
    sizes = collections.Counter()
    for _, size, source in rows:
        sizes[source] += size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget = sum(sizes.values()) * percent / 100
    full = set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (budget - sum(passes * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in names if s not in full and passes * sizes[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: float(passes * sizes[s]) if s in full else weight[s] * level for s in names}
    turns = []
    for s in names:
        for p in range(passes):
            for i, size, _ in (x for x in rows if x[2] == s):
                turns.append((s, p, int(hashlib.md5(f"mix:{i}:1:{p}".encode()).hexdigest()[:15], 16), i, size))
    run, timed = collections.Counter(), []
    for s, p, place, i, size in sorted(turns, key=lambda x: (x[0] is None, x[0] or "", x[1], x[2], x[3])):
        run[s] += size
        timed.append((run[s] / target[s] if target[s] else 0.0, place, i, p, size))
    used, taken = 0, collections.Counter()
    for _, _, i, _, size in sorted(timed):
        used += size
        if used <= budget:
            taken[i] += size
    return sorted((i, size, sizes[s], taken[i]) for i, size, s in rows), target, taken


@pytest.mark.parametrize(("weights", "percent", "passes"), [((5, 2, 1), 150, 2), ((1,), 50, 1), ((3, 1), 260, 3)])
def test_fair_mixing(table, prose, weights, percent, passes):
    r = random.Random(percent)
    rows = [(i, prose(i, r.choice([1, 5, 40, 120])), None, r.choice([None, "", "a", "b", "b", "b", "b", "é", "z"])) for i in range(400)]
    df = table(rows)
    got = fair_mixing.mix(df, weights=weights, percent=percent, passes=passes).collect()
    want, target, taken = brute_mix([(i, len(re.findall(WORD, t)), s) for i, t, _, s in rows], weights, percent, passes)
    assert sorted((x.doc_id, x.size, x.source_size, x.taken) for x in got) == want
    source = {i: s for i, _, _, s in rows}
    assert all(abs(x.target - target[source[x.doc_id]]) < 1e-6 for x in got)
    for s, t in target.items():
        assert abs(sum(n for i, n in taken.items() if source[i] == s) - t) <= 3 * 120
    assert all(x.taken == x.times * x.size for x in got)


def test_fair_mixing_on_odd_rows(table, odd_rows):
    df = table(odd_rows)
    got = fair_mixing.mix(df).collect()
    assert len(got) == len(odd_rows) and all(x.taken <= 2 * x.size for x in got)
    again = fair_mixing.mix(df.repartition(5)).collect()
    key = lambda x: (x.doc_id or 0, x.copy)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert fair_mixing.mix(table([])).count() == 0
    docs = fair_mixing.mixed_documents(df)
    assert docs.columns == df.columns and docs.count() == sum(x.times for x in got)
    assert fair_mixing.mixed_documents(table([])).count() == 0


def test_fair_mixing_of_empty_texts(table):
    got = fair_mixing.mix(table([(1, "", None, "a"), (2, None, None, "b")])).collect()
    assert [(x.size, x.taken, x.target) for x in got] == [(0, 0, 0.0)] * 2


def brute_lines(docs):
    """Lines dropped per doc_id, with templates as tuples of words."""
    templates, places = collections.defaultdict(set), []
    for i, t in docs:
        for no, line in enumerate((t or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(WORD, line)]
            n = len(w)
            if n < 5:
                continue
            ends = [3 + -(-(n - 3) * j // 4) for j in range(5)]
            parts = [tuple(w[ends[j] : ends[j + 1]]) for j in range(4)]
            keys = [(n, *w[:3], *("*" if k == j else p for k, p in enumerate(parts)), j) for j in range(-1, 4)]
            for k in keys:
                templates[k].add(i)
            places.append((i, no, n, keys))
    return {
        (i, no) for i, no, n, keys in places
        if any(len(templates[k]) >= 2 and len(templates[k]) * n >= 100 and i > min(templates[k]) for k in keys)
    }


def test_line_templates(table, prose):
    r = random.Random(8)
    common = [prose(900 + k, n) for k, n in enumerate([4, 5, 9, 20, 60, 110])]
    rows = []
    for i in range(60):
        lines = [prose(1000 * i + k, r.randint(3, 30)) for k in range(5)]
        for c in common:
            if r.random() < 0.4:
                lines.insert(r.randrange(len(lines)), c if r.random() < 0.5 else edited(c, r, 1))
        if r.random() < 0.5:
            lines.append(f"Page {r.randrange(99)} of the long report number {r.randrange(999)} printed on day {i} for all who read it " + "and more " * 8)
        rows.append((i, "\n".join(lines)))
    gone = brute_lines(rows)
    assert len(gone) > 60
    got = {x.doc_id: x for x in line_templates.without_recurring(table([(i, t, None, None) for i, t in rows])).collect()}
    for i, t in rows:
        want = [x for no, x in enumerate(t.split("\n")) if (i, no) not in gone]
        assert got[i].text == "\n".join(want) and got[i].n_dropped == sum(a == i for a, _ in gone)


def test_whole_line_rule(table, prose):
    """Equal lines go by documents alone, short ones from a stated count on or with their passage; the first copy stays."""
    long, digits, unspaced = prose(1, 8), "part 7 of the 20 notes kept here", "这是没有空格的一行文字" * 5
    passage = [f"line {prose(50 + k, 1)}" for k in range(30)]  # no line of it is long enough by itself
    field = lambda i: f"Report of the day by {prose(700 + i, 1)} sent to all the readers"
    texts = collections.defaultdict(lambda: [])
    for i in (3, 8):
        texts[i] += [long, digits, unspaced]
    for i in (5, 9):
        texts[i] += [*passage[:10], "", *passage[10:]]
    for i in range(20, 24):
        texts[i].append(field(i))
    for i in range(30, 33):
        texts[i].append(f"Only three of these lines {prose(800 + i, 1)} are there now")
    for i in range(40, 50):
        texts[i].append("All rights reserved.")
    for i in range(60, 69):
        texts[i].append("Nine of these")
    rows = [(i, "\n".join([prose(100 * i + 7, 12), *x, prose(100 * i + 8, 12)])) for i, x in texts.items()]
    rows.append((90, digits.replace("7", "8")))  # another number is another line
    got = {x.doc_id: x for x in line_templates.without_recurring(table([(i, t, None, None) for i, t in rows]), whole=True).collect()}
    lost = {i: x.n_dropped for i, x in got.items() if x.n_dropped}
    assert lost == {8: 3, 9: 30, 21: 1, 22: 1, 23: 1, **{i: 1 for i in range(41, 50)}}
    assert all(got[i].text == t for i, t in rows if i not in lost) and long not in got[8].text and passage[0] in got[5].text


def test_query_of_line_templates_takes_the_whole_rule(spark, tmp_path, prose):
    import __spark_entry__ as entry

    line = prose(1, 20)
    spark.createDataFrame([(i, f"{prose(i + 2, 9)}\n{line}") for i in (1, 2)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in entry.queries()["op9_line_templates"](spark, str(tmp_path)).collect()}
    assert line in out[1].kept_text and line not in out[2].kept_text


def test_line_templates_on_odd_rows(table, odd_rows):
    df = table(odd_rows)
    out = line_templates.without_recurring(df)
    rows = out.collect()
    assert len(rows) == len(odd_rows) and out.columns == [*df.columns, "n_lines", "n_dropped"]
    texts = collections.defaultdict(list)
    for x in rows:
        texts[x.doc_id].append(x.text)
    assert texts[2] == [None] and texts[3] == [""] and texts[5] == [""] and texts[1][0] and texts[6][0] == texts[6][1]
    assert all(t for t in texts[6]) and line_templates.without_recurring(table([])).count() == 0
