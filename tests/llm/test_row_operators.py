"""Operators that work on one text at a time, against plain Python."""

import collections
import hashlib
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from quernlog.llm import bpe_chunks, language_id, lm_difference, packed, rule_ensemble, rule_ledger, textarrays, unigram_counts

WORD = r"[^\x20\x09-\x0D]+"


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def measures(text):
    w = re.findall(WORD, text or "")
    n = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_ledger_on_odd_rows(table, odd_rows):
    rows = rule_ledger.ledger(table(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i or 0, *measures(t)) for i, t, _, _ in odd_rows)
    assert {r.fail_bits for r in rows if r.n_words == 0} == {1}


@pytest.mark.parametrize("hashes", [1, 3, 1 << 35])
def test_repeated_words_are_exact_where_hashes_collide(table, monkeypatch, hashes):
    monkeypatch.setattr(rule_ledger, "_HASHES", hashes)
    r = random.Random(hashes)
    texts = ["A p q B r s A", "A p q B r s A p q", *(" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(60))]
    got = {x.doc_id: x.n_repeat_words for x in rule_ledger.ledger(table([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({p for k, g in enumerate(grams) if grams.count(g) > 1 for p in (k, k + 1, k + 2)}), t


@pytest.mark.parametrize(
    "hashes, places",
    [([5, 9, 5, 7, 9, 5], [0, 2, 5, 1, 4]), ([1, 2, 3], []), ([], []), ([4, 4], [0, 1]), ([8, 8, 8, 8], [0, 1, 2, 3]), ([-1, 6, (1 << 63) - 1], [0, 2])],
)
def test_only_windows_of_a_shared_hash_are_compared(spark, hashes, places):
    rows = spark.createDataFrame([(hashes,)], "h array<long>")
    order = rows.select(F.sort_array(F.transform("h", rule_ledger.packed)).alias("order"))
    out = order.select(F.transform(rule_ledger.of_shared_hashes("order"), rule_ledger.place_of)).head()[0]
    assert out == places


def test_ledger_allocates_little_where_nothing_repeats(spark):
    n_docs, n_words = 40, 3000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n_words)), lambda i: F.concat(F.lit("w"), i)), " ")
    docs = spark.range(0, n_docs, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text")).cache()
    threads = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()

    def allocated(rows):
        before = sum(threads.getThreadAllocatedBytes(threads.getAllThreadIds()))
        rows.write.format("noop").mode("overwrite").save()
        return sum(threads.getThreadAllocatedBytes(threads.getAllThreadIds())) - before

    try:
        assert docs.count() == n_docs and {r.n_repeat_words for r in rule_ledger.ledger(docs).collect()} == {0}
        assert min(allocated(rule_ledger.ledger(docs)) - allocated(docs) for _ in range(4)) < 1700 * n_docs * n_words
    finally:
        docs.unpersist()


def test_ledger_of_nothing_and_unknown_policy(table):
    rows = rule_ledger.apply_policy(rule_ledger.ledger(table([])), "strict-1")
    assert rows.count() == 0 and rule_ledger.ablation(rows, "strict-1").count() == 0
    with pytest.raises(KeyError):
        rule_ledger.apply_policy(rows, "none")


def test_ablation_counts(spark):
    bits = [0, 1, 1, 3, 4, 5, 0]
    rows = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    out = {r.rule: (r.n_failed, r.n_only_this, r.n_kept_without) for r in rule_ledger.ablation(rows, "strict-1").collect()}
    for place, rule in enumerate(rule_ledger.RULES):
        bit = 1 << place
        assert out[rule.name] == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    base = {r.rule for r in rule_ledger.ablation(rows, "base-1").collect()}
    assert base == set(rule_ledger.BASE)


def test_span_hashes_do_not_depend_on_place():
    one, two = textarrays.word_hashes(textarrays.code_points("ab cd ab")), textarrays.word_hashes(textarrays.code_points("\tcd  ab\n"))
    assert one[0] == one[2] == two[1] and one[1] == two[0] and one[0] != one[1]
    assert len(textarrays.word_hashes(textarrays.code_points(""))) == 0


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe_chunks.default_vocabulary())


def test_bpe_agrees_with_the_library(reference):
    codec = bpe_chunks.Codec(bpe_chunks.default_vocabulary())
    r = random.Random(4)
    parts = [
        "a", " ", "  ", "\n", "the", " The", "é", " ñ", "'s", "'ll", "12", " 3", "<|endoftext|>", "<|endo", "中", "文 ", " ",
        "　", "?!", "\t", "\x1c", "\u0085", "😀", "़", "क", "x" * 50, "\r\n", "﻿", "ß",
    ]
    plain = ["the", " and", " of", "ing", ".", ",", "\n", " ñ", "é"]
    for k in range(120):
        text = "".join(r.choice(plain if k % 2 else parts) for _ in range(r.choice([0, 3, 60, 3000])))
        want = reference.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.decode(want) == reference.decode(want, skip_special_tokens=False)


def test_bpe_reuses_chunks_across_documents():
    shared = " ".join(f"word{k * k % 997}" for k in range(4000))
    cut = set(bpe_chunks.cuts("A new beginning of another length. " + shared))
    offset = len("A new beginning of another length. ")
    assert len({c + offset for c in bpe_chunks.cuts(shared)} & cut) > 5
    codec = bpe_chunks.Codec(bpe_chunks.default_vocabulary())
    codec.encode(shared)
    stored = len(codec.chunks)
    codec.encode("A new beginning of another length. " + shared)
    assert len(codec.chunks) <= stored + 3


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "KEPT", 5000)
    codec = bpe_chunks.Codec(bpe_chunks.default_vocabulary())
    for k in range(40):
        codec.encode(" ".join(f"w{k}x{j}" for j in range(300)))
    assert codec.kept <= 5000 + max(map(len, codec.chunks))


def test_bpe_on_odd_rows(table, odd_rows, reference):
    df = table(odd_rows)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.digests(df).collect())
    want = []
    for i, t, _, _ in odd_rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        listed = ",".join(map(str, ids))
        want.append((i or 0, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe_chunks.encoded(df)
    assert all(r.exact for r in full.collect())
    back = sorted((r.doc_id or 0, r.text) for r in bpe_chunks.decoded(full).collect())
    assert back == sorted((i or 0, t or "") for i, t, _, _ in odd_rows)
    assert bpe_chunks.digests(table([])).count() == 0


def test_unigram_counts_agree_with_the_library(table, odd_rows):
    vocabulary = unigram_counts.pieces(unigram_counts.default_vocabulary())
    named = [(p or chr(0x10FFF0 + i), s) for i, (p, s) in enumerate(vocabulary)]
    library = Tokenizer(models.Unigram(named, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = unigram_counts.Counter(vocabulary)
    r = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "the", " The", "é", "ß", "<s>", "12", "中", "😀", "़", "x" * 30, "<0x0A>", "▁", "re", "tion", "\x00", "aa"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 3, 8, 40])))
        assert counter.text(text)[0] == len(library.encode(text).ids), text
    got = sorted((x.doc_id or 0, x.n_tokens) for x in unigram_counts.count(table(odd_rows)).collect())
    assert got == sorted((i or 0, len(library.encode(t or "").ids)) for i, t, _, _ in odd_rows)
    assert unigram_counts.count(table([])).count() == 0


def test_unigram_ties_take_the_earlier_start():
    counter = unigram_counts.Counter([("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("▁aa", -3.0)])
    library = Tokenizer(models.Unigram([("?", -9.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("▁aa", -3.0)], unk_id=0))
    for text in ("▁a", "▁aa", "▁aaa", "▁aaaa", "▁aaaaa"):
        assert counter.word(text)[0] == len(library.encode(text).ids)


def test_language_id(table, prose, odd_rows):
    rows = [(i, prose(i, 60, lang), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)] + [(1000, "123 ---", "en", "s"), (1001, None, "de", "s")]
    docs = table(rows)
    model = language_id.fit(docs, language_id.fold("doc_id", 5) == 0)
    out = language_id.identify(docs.withColumn("held_out", language_id.fold("doc_id", 5) == 0), model, ["doc_id", "held_out"]).collect()
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(held) > 15 and all(r.lang_pred == ["en", "de", "fr"][r.doc_id % 3] for r in held)
    assert sum(r.rejected for r in out if r.doc_id < 1000) <= 3
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id >= 1000:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    again = language_id.fit(docs, language_id.fold("doc_id", 5) == 0)
    assert np.array_equal(again.table, model.table) and again.threshold == model.threshold
    found = by_id(language_id.identify(table(odd_rows), model, ["doc_id", "n_words"]))
    assert sum(map(len, found.values())) == len(odd_rows) and found[3][0].lang_pred == "und" and found[1][0].score == found[5][0].score


def test_language_id_scores_do_not_depend_on_the_batch(table, prose):
    docs = table([(i, prose(i, 40, lang), lang, "s") for i, lang in enumerate(["en", "de"] * 20)])
    model = language_id.fit(docs, F.lit(False))
    texts = [prose(500 + i) for i in range(7)]
    assert [model.score([t])[1][0] for t in texts] == list(model.score(texts)[1])


def test_language_id_rejects_languages_it_has_not_learnt(table, prose):
    """One language is left out of learning; most of its texts go, nearly all others stay."""
    rows = [(i, prose(i, 60, lang), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    foreign = {"pl": ["szcz", "owie", "ły", "prz", "ką", "dzi"], "xx": ["\u0436\u0430", "\u043b\u043e", "\u0449\u0438", "\u043d\u043a"]}
    strange = [(1000 + i, " ".join("".join(random.Random(i * 99 + k).choices(parts, k=3)) for k in range(60)), None, "s") for i, parts in enumerate(list(foreign.values()) * 20)]
    model = language_id.fit(table(rows), language_id.fold("doc_id", 5) == 0)
    out = language_id.identify(table(rows + strange), model, ["doc_id"]).collect()
    assert sum(r.rejected for r in out if r.doc_id < 1000) <= 3
    assert sum(r.rejected for r in out if r.doc_id >= 1000) >= 30
    assert max(r.score for r in out if r.doc_id >= 1000) < 0.99


def test_language_id_buckets_by_hand():
    """N-grams of two to four characters inside a word and its borders, in plain Python."""
    def mixed(v):
        return int(textarrays.mix64(np.array([v & (2**64 - 1)], np.uint64))[0]) >> (64 - language_id.BUCKET_BITS)

    want = []
    for word in ("ab", "Ünïx"):
        points = [0, *(ord(c) for c in word.lower()), 0]
        for size in (2, 3, 4):
            for at in range(len(points) - size + 1):
                gram, value = points[at : at + size], points[at]
                if 0 in gram[1:-1]:
                    continue
                for k in range(1, size):
                    value = value * 0x9E3779B97F4A7C15 + gram[k] + k
                want.append(mixed(value))
    grams = language_id.subwords(["ab 12 Ünïx"])[0]
    assert sorted(grams[grams < language_id.BUCKETS].tolist()) == sorted(want)


def test_language_id_learning_rows_are_not_copied(table, prose):
    rows = [(i, prose(i, 40), "en", None) for i in range(6)]
    made = language_id.learning_rows(table(rows).select("doc_id", "lang", "text"), F.lit(False)).toArrow()
    order = sorted(range(6), key=made["doc_id"].to_pylist().__getitem__)
    buckets, shares = (made[c].combine_chunks() for c in ("buckets", "shares"))
    dense = language_id._Rows.of(buckets, shares, np.array(order)).dense(np.arange(6))
    for i, text, _, _ in rows:
        grams = language_id.subwords([text])[0]
        counts = np.bincount(grams[grams < language_id.BUCKETS], minlength=language_id.BUCKETS)
        assert np.array_equal(dense[i], (counts / counts.sum()).astype(np.float32))
    borders = pa.array(np.arange(0, 2_000_001, 1000), pa.int32())
    large = [pa.ListArray.from_arrays(borders, pa.array(np.ones(2_000_000, kind))) for kind in (np.int16, np.float32)]
    tracemalloc.start()
    language_id._Rows.of(*large, np.arange(2000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000


def test_language_id_without_labels(table, prose):
    model = language_id.fit(table([(1, prose(1), None, "s")]), F.lit(False))
    assert [r.lang_pred for r in language_id.identify(table([(1, prose(1), None, "s")]), model, ["doc_id"]).collect()] == ["und"]
    assert language_id.identify(table([]), model, ["doc_id"]).count() == 0


def test_rule_ensemble_learns_held_out_rows(spark, table, prose):
    rows, labels = [], []
    for i in range(160):
        text = prose(i, 60 + i % 40)
        bad = i % 4 == 0
        rows.append((i, text.replace(" ", "%%% ") if bad else text, "en", "s"))
        labels.append((i, 0 if bad else 1))
    statistics = rule_ensemble.with_statistics(table(rows).select("doc_id", "text"))
    held = F.col("doc_id") % 5 == 0
    model = rule_ensemble.fit(statistics.filter(~held), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0 < len(model.rules) < 60
    for r in rule_ensemble.score(statistics.filter(held), model).collect():
        assert 0 <= r.score <= 1 and r.predicted == (0 if r.doc_id % 4 == 0 else 1)


def test_rule_ensemble_learns_from_a_bounded_sample(spark, table, prose):
    rows = [(i, prose(i, 5 + i % 7), None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 3 + [(3, 0), (4, None)], "doc_id long, quality int")
    statistics = rule_ensemble.with_statistics(table(rows + rows[:50]).select("doc_id", "text"))
    assert rule_ensemble.learning_rows(statistics, labels).count() == 400
    some = rule_ensemble.learning_rows(statistics, labels, most=200).collect()
    assert 50 <= len(some) <= 200 and some == rule_ensemble.learning_rows(statistics.repartition(3), labels, most=200).collect()


def test_rule_ensemble_statistics_by_hand(table):
    text = "Ab, cd! cd $9\n\nlonger.word Ab,\n cd"
    w = text.split()
    letters = sum(map(len, w))
    r = rule_ensemble.with_statistics(table([(1, text, None, None)]).select("doc_id", "text")).first()
    want = {
        "n_words": len(w), "word_length": letters / len(w), "distinct_words": len(set(w)) / len(w), "symbols_per_word": 1 / len(w),
        "exclamations_per_word": 1 / len(w), "capitals_per_letter": 2 / letters, "stops_per_word": 3 / len(w), "digits_per_letter": 1 / letters,
        "line_words": len(w) / 3, "repeated_lines": 0.0, "longest_word": 11,
    }
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: r[k] for k in rule_ensemble.STATISTICS}


def test_rule_ensemble_column_equals_plain_sum(spark):
    rule = (("n_words", True, 3.0), ("word_length", False, 5.0))
    model = rule_ensemble.Ensemble(0.5, [(rule, -2.0), ((("n_words", False, 1.0),), 1.0)])
    rows = spark.createDataFrame([(float(a), float(b)) for a in (0, 1, 3, 4) for b in (5, 6)], "n_words double, word_length double")
    for r in rows.withColumn("score", model.column()).collect():
        total = 0.5 + (-2.0 if r.n_words > 3 and r.word_length <= 5 else 0) + (1.0 if r.n_words <= 1 else 0)
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)))


def test_rule_ensemble_on_odd_rows(spark, table, odd_rows):
    statistics = rule_ensemble.with_statistics(table(odd_rows).select("doc_id", "text"))
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = rule_ensemble.fit(statistics, none)
    rows = rule_ensemble.score(statistics, model).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.5}
    assert rule_ensemble.with_statistics(table([])).count() == 0
    empty = [r for r in statistics.collect() if r.n_words == 0]
    assert all(r[s] == 0 for r in empty for s in rule_ensemble.STATISTICS)


def test_lm_difference_prefers_the_target(spark, table, prose):
    rows = [(i, prose(i, 80, "en" if i % 2 else "de"), None, None) for i in range(120)]
    target = spark.createDataFrame([(i,) for i in range(1, 120, 2)], "doc_id long")
    out = by_id(lm_difference.score(table(rows), lm_difference.fit(table(rows), target)))
    good, bad = [out[i][0].score for i in range(1, 120, 2)], [out[i][0].score for i in range(0, 120, 2)]
    assert max(good) < min(bad)


def test_lm_losses_against_plain_counts(spark, table, prose, monkeypatch):
    rows = [(i, prose(i % 7, 30), None, None) for i in range(16)]
    half = {r.doc_id: r.h for r in table(rows).select("doc_id", lm_difference.half().alias("h")).collect()}
    target = {i for i in range(16) if i % 3 == 0}
    out = by_id(lm_difference.score(table(rows), lm_difference.fit(table(rows), spark.createDataFrame([(i,) for i in target], "doc_id long"))))
    split = {i: re.findall(WORD, t) for i, t, _, _ in rows}
    known = {w for x in split.values() for w in x}
    begin = len(known) + 1
    for i, w in split.items():
        others = [j for j in split if half[j] != half[i]]
        sizes, losses = {}, {}
        for name, members in (("target", [j for j in others if j in target]), ("background", others)):
            one = collections.Counter(x for j in members for x in split[j])
            two = collections.Counter(p for j in members for p in zip(["<s>", *split[j]], split[j]))
            one["<s>"] = len(members)
            sizes[name] = sum(len(split[j]) for j in members)
            k = sizes["target"] / max(1, sizes[name])
            total = k * sizes[name]
            losses[name] = -sum(
                math.log((k * two[v, x] + 8 * (k * one[x] + 1 / begin) / (total + 1)) / (k * one[v] + 8)) for v, x in zip(["<s>", *w], w)
            ) / len(w)
        r = out[i][0]
        assert r.n_words == len(w) and math.isclose(r.target_loss, losses["target"], rel_tol=1e-4)
        assert math.isclose(r.background_loss, losses["background"], rel_tol=1e-4) and math.isclose(r.score, r.target_loss - r.background_loss)


def test_lm_counts_every_word_and_bigram(spark, table, monkeypatch):
    """More distinct words and bigrams than any fixed array held: rare words keep counts of their own, in the join too."""
    rows = [(i, " ".join(f"w{(i // 2) * 300 + j}" for j in range(300)), None, None) for i in range(400)]
    target = {i for i in range(400) if i % 3 == 0}
    docs, wanted = table(rows), spark.createDataFrame([(i,) for i in target], "doc_id long")
    half = {r.doc_id: r.h for r in docs.select("doc_id", lm_difference.half().alias("h")).collect()}
    monkeypatch.setattr(lm_difference, "FREQUENT", 50, raising=False)
    out = by_id(lm_difference.score(docs, lm_difference.fit(docs, wanted)))
    begin = 200 * 300 + 1
    words = {(h, m): sum(300 for i in range(400) if half[i] == h and (m or i in target)) for h in range(2) for m in range(2)}
    for i in range(400):
        h, twin = 1 - half[i], i ^ 1  # the twin is the only other document with these words
        for m, got in enumerate((out[i][0].target_loss, out[i][0].background_loss)):
            k = words[h, 0] / words[h, 1] if m else 1.0
            c = k if half[twin] == h and (m or twin in target) else 0.0
            texts = k * sum(half[j] == h and (m or j in target) for j in range(400))
            u = (c + 1 / begin) / (k * words[h, m] + 1)
            want = -(math.log((c + 8 * u) / (texts + 8)) + 299 * math.log((c + 8 * u) / (c + 8))) / 300
            assert math.isclose(got, want, rel_tol=1e-9)


def test_lm_counts_in_little_memory():
    random = np.random.default_rng(5)
    held = [(random.integers(0, 300, n).astype(np.uint64), random.integers(0, 300, n).astype(np.uint64), random.integers(0, 4, n).astype(np.int8)) for n in (0, 9000, 1)]
    want = collections.defaultdict(lambda: [0] * 4)
    for part in held:
        for word, pair, kind in zip(*(x.tolist() for x in part)):
            want[word, pair][kind // 2 * 2 + 1] += 1
            want[word, pair][kind // 2 * 2] += kind % 2
    got = [r for b in lm_difference._tallied(held) for r in zip(*b.to_pydict().values())]
    assert len(got) == len(want) and {r[:2]: list(r[2:]) for r in got} == want and not held
    assert not list(lm_difference._tallied([(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8))]))
    held = [(np.arange(10_000, dtype=np.uint64) + 10_000 * i, np.ones(10_000, np.uint64), np.ones(10_000, np.int8)) for i in range(lm_difference.HELD // 10_000)]
    tracemalloc.start()
    assert sum(b.num_rows for b in lm_difference._tallied(held)) == lm_difference.HELD
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160_000_000


def test_packed_numbers():
    r = np.random.default_rng(3)
    for x in (np.zeros(0, np.int64), np.zeros(5, np.int64), np.array([0, 255, 256, 1 << 40, (1 << 63) - 1]), r.integers(0, 9, 1000).astype(np.int32)):
        assert packed.unpack(packed.pack(x)).tolist() == x.tolist()
    keys = np.unique(np.append(r.integers(0, 1 << 64, 5000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
    assert packed.unpack_sorted(packed.pack_sorted(keys)).tolist() == keys.tolist()
    assert packed.unpack_sorted(packed.pack_sorted(keys[:0])).tolist() == []


def test_byte_words_against_plain_words():
    r = random.Random(4)
    long = ["x" * n + end for n in (6, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for end in ("", "y", "\0", "é")]
    pool = ["a", "A", "Ab", "aB", "[", "{", "@", "É", "é", "中文", "\0", "\0\0", "\x85", "\u00a0b", "😀", "abcdefgh", "ABCDEFGHi", *long, *map(str.upper, long)]
    texts = ["", " ", "\t\n", *("".join(r.choice(pool) + r.choice([" ", "\n", "\t\r", "  "]) for _ in range(r.randint(0, 60))) for _ in range(200)), "end", ""]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    words = [re.findall(WORD, t) for t in low]
    hashes, sizes = textarrays.byte_words([t.encode() for t in texts])
    assert sizes.tolist() == [len(w) for w in words]
    named = set(zip((x for w in words for x in w), hashes.tolist()))
    assert len(named) == len({x for x, _ in named}) == len({h for _, h in named})
    for some in ([], [b""], [b" "]):
        hashes, sizes = textarrays.byte_words(some)
        assert not len(hashes) and sizes.tolist() == [0] * len(some)


def test_distinct_and_numbered():
    for x in (np.zeros(0, np.uint64), np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64) >> np.uint64(53), np.full(3, (1 << 64) - 1, np.uint64)):
        want, places = np.unique(x, return_inverse=True)
        assert np.array_equal(textarrays.distinct(x), want)
        assert all(np.array_equal(a, b) for a, b in zip(textarrays.numbered(x), (want, places)))


def test_lm_chunk_takes_less_time_than_plain_sets():
    """Distinct bigrams went through a hash table that took most of the time, more than sets of plain tuples."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 100_000, 1000)) for _ in range(1000)]
    group = pa.table({"text": texts})

    def plain():
        pairs = set()
        for t in texts:
            words = t.split()
            pairs.update(zip(["", *words], words))
        return len(pairs)

    def timed(f):
        took = []
        for _ in range(3):
            start = time.process_time()
            out = f()
            took.append(time.process_time() - start)
        return out, min(took)

    (words, pairs), spent = timed(lambda: lm_difference._asked(group))
    n, limit = timed(plain)
    assert len(words) == len({w for t in texts for w in t.split()}) + 1 and len(pairs) == n
    assert spent < limit


def test_lm_texts_are_read_once_for_their_losses(monkeypatch):
    read, tokens = [], lm_difference._tokens

    def counted(texts):
        read.append(len(texts))
        return tokens(texts)

    monkeypatch.setattr(lm_difference, "_tokens", counted)
    group = pa.table({"doc_id": range(5), "text": ["a b a", "", "c", " ", "b"]})
    nothing = pa.table({c: [] for c in ("part", "pair", "found", "target", "background")})
    n, losses = lm_difference._losses((1, np.ones((2, 2)), np.ones((2, 2)), 4), 0, group, nothing)
    assert sum(read) == 5 and n.tolist() == [3, 0, 1, 0, 1] and all(x.tolist() == [0] * 5 for x in losses)


def test_lm_counts_go_out_in_few_bytes():
    """A row for each bigram took 24 bytes, more than the input's budget of disk."""
    r = np.random.default_rng(8)
    word, pair = (r.integers(1, 1 << 64, 300_000, np.uint64) for _ in range(2))
    kinds = r.integers(0, 4, 300_000).astype(np.int8)
    held = [(word, pair, kinds), (word, np.zeros(300_000, np.uint64), kinds)]
    rows = list(lm_difference._packed_counts(lm_difference._tallied(held), 7))
    assert {x[:2] for x in rows} == {(part, kind) for part in range(7) for kind in (False, True)}
    for kind, keys in ((False, word), (True, pair)):
        mine = [x for x in rows if x[1] == kind]
        assert np.array_equal(np.concatenate([packed.unpack_sorted(x[2]) for x in mine]), np.sort(keys))
        assert [sum(int(packed.unpack(x[3 + i]).sum()) for x in mine) for i in range(4)] == [(kinds == 1).sum(), (kinds <= 1).sum(), (kinds == 3).sum(), (kinds >= 2).sum()]
    assert sum(len(b) for x in rows for b in x[2:]) < 9 * 600_000


def test_lm_ranges_chunks_and_filter_change_nothing(spark, table, prose, monkeypatch):
    rows = [(i, prose(i % 9, 40), None, None) for i in range(40)] + [(None, "a b", None, None), (3, prose(3, 40), None, None), (3, "x y x", None, None)]
    want = spark.createDataFrame([(i,) for i in (*range(0, 40, 3), 3, 99, None)], "doc_id long")

    def run(target):
        out = lm_difference.score(table(rows), lm_difference.fit(table(rows), target)).collect()
        return sorted((r.doc_id or -1, r.n_words, round(r.target_loss, 9), round(r.background_loss, 9), round(r.score, 9)) for r in out)

    plain = run(want)
    assert len(plain) == len(rows) and plain == run(want.selectExpr("cast(doc_id as int) doc_id"))
    monkeypatch.setattr(lm_difference, "RANGE", 300)
    monkeypatch.setattr(lm_difference, "CHUNK", 500)
    monkeypatch.setattr(lm_difference, "FILTER_BITS", 8)
    assert plain == run(want)


def test_lm_texts_move_only_to_possible_marks(spark, table):
    docs, want = table([(i, "a", None, None) for i in range(4000)]), spark.createDataFrame([(i,) for i in range(0, 4000, 40)], "doc_id long")
    passed = {r.doc_id for r in docs.filter(lm_difference._filter(docs, want)).select("doc_id").collect()}
    assert passed >= set(range(0, 4000, 40)) and len(passed) < 600


def test_lm_difference_on_odd_rows(spark, table, odd_rows):
    nothing = spark.createDataFrame([], "doc_id long")
    out = lm_difference.score(table(odd_rows), lm_difference.fit(table(odd_rows), nothing)).collect()
    assert len(out) == len(odd_rows) and all(math.isfinite(r.score) for r in out)
    assert all(r.score == 0 for r in out if r.n_words == 0)
    assert lm_difference.score(table([]), lm_difference.fit(table([]), nothing)).count() == 0
