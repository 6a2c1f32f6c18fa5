"""The pipeline's stages and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op") and n.split("_")[0][2:].isdigit()]
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, table, prose):
    rows = [(i, prose(i, 60 + i % 9, lang), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(200, rows[0][1], "en", "s0"), (201, "1234 ---", "en", "s1"), (202, None, None, None)]
    passage = prose(5000, 70)
    rows = [(i, f"{t}\n{passage}" if t and i in (5, 6, 7, 8) else t, lang, s) for i, t, lang, s in rows]
    docs = table(rows)
    columns = docs.columns
    docs = corpus_pipeline.identified(spark, docs, "").cache()
    assert docs.columns == columns and {201, 202} & {r.doc_id for r in docs.collect()} == set() and docs.count() >= len(rows) - 4
    docs = corpus_pipeline.without_boilerplate(spark, docs, "").cache()
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and [passage in kept[i].text for i in (5, 6, 7, 8)] == [True, False, False, False]
    assert all(r.n_chars == len(r.text) for r in kept.values())
    docs = corpus_pipeline.without_copies(spark, docs, "").cache()
    assert docs.columns == columns and len(kept) - docs.count() <= 1
    docs = corpus_pipeline.mixed(spark, docs, "").cache()
    assert docs.columns == columns and docs.count() > 90
    last = corpus_pipeline.tokenized(spark, docs, "")
    assert last.count() == docs.count() and all(r.exact and r.n_tokens == len(r.ids) for r in last.collect())


def test_copies_leave_one(spark, table, prose):
    text = prose(1, 100)
    near = text.replace(text.split(" ")[50], "changed", 1)
    out = corpus_pipeline.without_copies(spark, table([(4, text, "en", "s"), (2, near, "en", "s"), (9, text, "en", "s"), (3, prose(2), "en", "s")]), "")
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def test_copies_under_a_repeated_id_go(spark, table, prose):
    a, b = prose(1, 100), prose(2, 100)
    near = a.replace(a.split(" ")[50], "changed", 1)
    out = corpus_pipeline.without_copies(spark, table([(1, a, "en", "s"), (7, a, "en", "s"), (7, b, "en", "s"), (1, near, "en", "s"), (8, None, "en", "s")]), "")
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == 3 and (7, b) in kept and (8, None) in kept and {(1, a), (1, near)} & set(kept)


def test_boilerplate_keeps_columns_of_any_name(spark, prose):
    line = prose(3, 30)
    rows = [(i, f"{prose(i + 10, 40)}\n{line}", "x", i) for i in range(3)] + [(9, None, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_dropped long")
    out = corpus_pipeline.without_boilerplate(spark, docs, "")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and [line in got[i].text for i in range(3)] == [True, False, False]
    assert [(got[i].n_lines, got[i].n_dropped) for i in (0, 1, 9)] == [("x", 0), ("x", 1), ("y", None)] and got[9].text is None
    assert corpus_pipeline.without_boilerplate(spark, docs.limit(0), "").collect() == []


def test_run_on_a_small_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) > 250 and all(r.exact for r in rows)
