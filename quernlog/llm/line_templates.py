"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its number of words and its leading words to a leaf; words with a digit count as variable.
Below the leaf it is held word for word, digits included; and from LEAST_WORDS words on as a template with those words as
variable, and once for each of BLOCKS parts with that part as a variable field, so lines that differ in one part share a
template.  A template that recurs across documents is boilerplate: its line stays in the document with the smallest doc_id
and goes from all others.

The whole rule: equal lines recur in two documents, short ones in SHORT_DOCUMENTS; a template with a variable field in
VARIABLE_DOCUMENTS, or where words times documents reach MASS.  Equal lines that stand one after the other in two documents,
blank ones aside, are a passage and count as one line, so short lines of a passage go with it.  Without the whole rule, MASS
holds for every template and short lines stay.

Only leaves met in two documents or more go on, and only hashes are shuffled, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.llm.native import BLANKS, indices, let, salted_join, text_of
from quernlog.session import materialized

#: Leading words that lead to a leaf.
DEPTH = 3
BLOCKS = 4
#: Shorter lines have no variable field.
LEAST_WORDS = 5
#: A template recurs where words times documents reach this, in two documents at least.
MASS = 100
#: Documents in which a template with a variable field, and a short line by itself, recurs whatever its length.
VARIABLE_DOCUMENTS, SHORT_DOCUMENTS = 4, 10
#: A line has a word for so many characters at least: scripts without blanks are not short.
WORD_CHARACTERS = 6
_BLANK = "[\\x20\\x09-\\x0D]+"
_VARIABLE = "[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*"


def _keys(w: Column) -> Column:
    """The template itself, then the templates with one part as a variable field."""
    n = F.size(w)
    # parts of the words after the leading ones, the first parts longer where it doesn't come out even
    ends = [F.lit(DEPTH) + F.ceil((n - DEPTH) * j / BLOCKS).cast("int") for j in range(BLOCKS + 1)]
    parts = [F.xxhash64(F.slice(w, ends[j] + 1, ends[j + 1] - ends[j])) for j in range(BLOCKS)]

    def templates(p: Column) -> Column:
        gap = F.lit(0).cast("long")
        return F.array(*[F.xxhash64(F.col("leaf"), *[gap if k == j else p[k] for k in range(BLOCKS)], F.lit(j)) for j in range(-1, BLOCKS)])

    return let(F.array(*parts), templates)


def lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, line_no, place, n, size, leaf, equal, keys) of the lines with a word, or those long enough for a template.

    ``place`` numbers the lines that have a word.
    """
    numbered = F.transform(F.split(text_of(), "\n"), lambda x, i: F.struct(i.alias("no"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    each = docs.select("doc_id", F.posexplode(F.filter(numbered, lambda x: x["line"] != "")).alias("place", "x"))
    each = each.select("doc_id", "place", F.col("x.no").alias("line_no"), F.col("x.line").alias("line"))
    digits = F.col("line").rlike("[0-9]")
    general = F.when(digits, F.regexp_replace("line", _VARIABLE, "<*>")).otherwise(F.col("line"))
    each = (
        each.withColumns({"digits": digits, "w": F.split(general, _BLANK)})
        .withColumn("n", F.size("w"))
        .withColumns({
            "leaf": F.xxhash64("n", F.slice("w", 1, DEPTH)),
            # joined by one blank, so lines are equal whatever stands between their words
            "equal": F.xxhash64(F.when(F.col("digits"), F.regexp_replace("line", _BLANK, " ")).otherwise(F.array_join("w", " "))),
            "size": F.greatest("n", (F.length("line") / WORD_CHARACTERS).cast("int")),
        })
    )
    if not whole:
        each = each.filter(F.col("n") >= LEAST_WORDS)
    keys = F.when(F.col("n") >= LEAST_WORDS, _keys(F.col("w")))
    # a line without digits meets equal lines alone in its template without a field
    keys = F.when(F.col("digits"), keys).otherwise(F.slice(keys, 2, BLOCKS))
    return each.select("doc_id", "line_no", "place", "n", "size", "leaf", "equal", keys.alias("keys"))


def _passages(equal: DataFrame) -> DataFrame:
    """(doc_id, line_no) of lines that go with a passage: pairs of adjacent recurring lines, one of them short at least.

    ``equal`` has (doc_id, line_no, place, size, key) of all equal lines met in two documents.
    """
    row = F.struct("place", "line_no", "size", "key")
    after = F.lead(row).over(Window.partitionBy("doc_id").orderBy("place", "key"))
    pairs = (
        equal.select("doc_id", row.alias("a"), after.alias("b"))
        .filter((F.col("b.place") == F.col("a.place") + 1) & (F.least("a.size", "b.size") < LEAST_WORDS))
        .select("doc_id", "a", "b", F.xxhash64("a.key", "b.key").alias("pair"))
    )
    pairs = materialized(pairs)
    twice = (
        pairs.groupBy("pair").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
        .filter("keeper < last").select("pair", "keeper")
    )
    met = salted_join(pairs, twice, "pair", "doc_id").filter(F.col("doc_id") > F.col("keeper"))
    met = met.groupBy("doc_id", F.col("a.place").alias("place")).agg(F.first("a").alias("a"), F.first("b").alias("b"))
    run = F.col("place") - F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    return (
        met.withColumn("run", run).groupBy("doc_id", "run")
        .agg(F.sum("a.size").alias("size"), F.max(F.struct("place", "b")).alias("end"), F.collect_list("a.line_no").alias("nos"))
        .filter(F.col("size") + F.col("end.b.size") >= LEAST_WORDS)
        .select("doc_id", F.explode(F.concat("nos", F.array("end.b.line_no"))).alias("line_no"))
    )


def recurring_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, dropped): the places of the lines of each document that go, for documents that lose any."""
    every = materialized(lines(docs, whole))
    # kept, so that both sides of the join are plain exchanges, whose large partitions Spark splits
    shared = materialized(
        every.groupBy("leaf").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("leaf")
    )
    fields = ["doc_id", "line_no", "place", "n", "size"]
    keyed = F.concat(
        F.array(F.struct(F.col("equal").alias("key"), F.lit(True).alias("same"))),
        F.coalesce(F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(False).alias("same"))), F.array()),
    )
    rows = every.join(shared, "leaf", "left_semi").select(*fields, F.explode(keyed).alias("k")).select(*fields, "k.key", "k.same")
    rows = materialized(rows)
    mass = F.col("documents") * F.col("n") >= MASS
    alone = mass
    if whole:
        least = F.when(~F.col("same"), VARIABLE_DOCUMENTS).when(F.col("size") < LEAST_WORDS, SHORT_DOCUMENTS).otherwise(2)
        alone = (F.col("documents") >= least) | (mass & (F.col("n") >= LEAST_WORDS))
    templates = (
        rows.groupBy("key", "same", "doc_id").agg(F.first("n").alias("n"), F.min("size").alias("size"))
        .groupBy("key", "same")
        .agg(F.count("*").alias("documents"), F.min("doc_id").alias("keeper"), F.first("n").alias("n"), F.min("size").alias("size"))
        .filter(F.col("documents") >= 2).select("key", "keeper", alone.alias("alone"), "same")
        .filter(F.col("alone") | F.col("same") if whole else F.col("alone")).drop("same")
    )
    met = salted_join(rows.select("doc_id", "line_no", "place", "size", "key", "same"), templates, "key", "doc_id")
    if whole:
        met = materialized(met)
    gone = met.filter(F.col("alone") & (F.col("doc_id") > F.col("keeper"))).select("doc_id", "line_no")
    if whole:
        gone = gone.unionByName(_passages(met.filter("same").select("doc_id", "line_no", "place", "size", "key")))
    return gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("dropped"))


def without_recurring(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with the columns it has, recurring lines taken out of its text; and n_lines and n_dropped.

    ``whole`` applies the whole rule; the registered query and the pipeline do.

    A document that loses no line keeps its text as it is, null included.  A document of boilerplate alone stays with
    an empty text.  Rows with a null doc_id are left as they are and count for nothing.  Rows that share a doc_id are
    one document in the counts and lose the same places.  Lines repeated inside one document do not recur across
    documents.  An empty table gives no rows.  An input column named like an added one is replaced.
    """
    found = recurring_lines(docs.select("doc_id", "text").filter("doc_id is not null"), whole)
    found = found.select(F.col("doc_id").alias("_line_doc"), F.col("dropped").alias("_dropped"))
    pieces = F.split("text", "\n")
    left = let(pieces, lambda x: F.array_join(F.transform(F.array_except(indices(F.size(x)), F.col("_dropped")), lambda i: x[i]), "\n"))
    columns = {c: F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")}
    joined = docs.join(found, docs["doc_id"] == F.col("_line_doc"), "left")
    out = joined.select(
        *[left_if(left).alias("text") if c == "text" else columns[c] for c in docs.columns if c == "text" or c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(pieces)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out


def left_if(text: Column) -> Column:
    """The shortened text where lines go, else the text as it is."""
    return F.when(F.col("_dropped").isNotNull(), text).otherwise(F.col("text"))
