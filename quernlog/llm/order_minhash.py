"""Order MinHash fingerprints: sensitive to the order of passages, so to edit distance, not only to their set.

A text's k-mers of tokens are numbered by occurrence and hashed.  The hash space is cut into BINS parts; in each the
PICKS smallest k-mers are selected, put back into text order, and hashed as a tuple.  Two fingerprints are as alike as
the share of bins, filled in either, whose tuples agree.  All of it is one row's work in Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlog.llm.native import let, text_of
from quernlog.session import materialized

BIN_BITS = 6
BINS = 1 << BIN_BITS
PICKS = 2
#: A k-mer is packed as its hash above its place; the top bits of the hash are its bin.
_PLACE_BITS, _HASH_BITS = 27, 36
_PLACES, _HASHES = 1 << _PLACE_BITS, 1 << _HASH_BITS
_TUPLE_BITS = 24
#: Tokens of more characters are cut into overlapping pieces of so many characters each.
LONGEST_TOKEN, PIECE = 40, 4


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE_BITS + _HASH_BITS - BIN_BITS)


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _PLACE_BITS)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_PLACES - 1))


def _packed(value: Column, place: Column) -> Column:
    return F.shiftleft(value.bitwiseAND(F.lit(_HASHES - 1)), _PLACE_BITS).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACES - 1)))


def _numbered(order: Column) -> Column:
    """K-mers sorted by hash and place; all but the first of equal ones get a hash of their own from their number."""

    def number(v: Column, i: Column) -> Column:
        # the first of the run, by halving steps down from i
        steps = F.array(*[F.lit(1 << s) for s in range(_PLACE_BITS - 1, -1, -1)])
        first = F.aggregate(
            steps, i, lambda at, step: F.when((at >= step) & (_hash(F.get(order, at - step)) == _hash(v)), at - step).otherwise(at)
        )
        return i - first

    return F.transform(
        order,
        lambda v, i: F.when(
            _hash(F.get(order, i - 1)) == _hash(v), _packed(F.xxhash64(_hash(v), number(v, i)), _place(v))
        ).otherwise(v),
    )


def _tuples(picked: Column) -> Column:
    """One number per filled bin: the bin above the hash of its k-mers in text order."""

    def tuple_hash(v: Column, i: Column) -> Column:
        members = F.filter(F.slice(picked, i + 1, PICKS), lambda x: _bin(x) == _bin(v))
        in_order = F.sort_array(
            F.transform(members, lambda x: F.shiftleft(_place(x), _HASH_BITS).bitwiseOR(_hash(x)))
        )
        hashes = F.transform(in_order, lambda x: x.bitwiseAND(F.lit(_HASHES - 1)))
        value = F.xxhash64(hashes).bitwiseAND(F.lit((1 << _TUPLE_BITS) - 1))
        return F.shiftleft(_bin(v), _TUPLE_BITS).bitwiseOR(value).cast("int")

    heads = F.transform(
        picked,
        lambda v, i: F.when((i == 0) | (_bin(F.get(picked, i - 1)) != _bin(v)), tuple_hash(v, i)),
    )
    return F.filter(heads, lambda x: x.isNotNull())


def _tokens(text: Column) -> Column:
    """What stands between blanks; the pieces of a long token, as in scripts without blanks, take its place."""
    pieces = lambda c: F.transform(c, lambda _, i: F.array_join(F.slice(c, i + 1, PIECE), ""))
    cut = lambda w: F.when(F.length(w) > LONGEST_TOKEN, let(F.split(w, ""), pieces)).otherwise(F.array(w))
    words = F.split(text, " ")
    return F.when(text.rlike(f"[^ ]{{{LONGEST_TOKEN + 1}}}"), F.flatten(F.transform(words, cut))).otherwise(words)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as a sorted array of at most BINS numbers; an empty text counts as one empty token.

    Tokens are what stands between blanks, those of over LONGEST_TOKEN characters cut into pieces; a k-mer is a token with
    the next one (the last token alone).  Places are kept modulo 2**27, so order is exact up to so many tokens.
    """
    kmers = lambda w: F.sort_array(F.transform(w, lambda x, i: _packed(F.xxhash64(x, F.get(w, i + 1)), i)))
    picked = lambda s: F.filter(s, lambda v, i: (i < PICKS) | (_bin(F.get(s, i - PICKS)) != _bin(v)))
    return let(
        _tokens(text),
        lambda w: let(kmers(w), lambda order: let(F.sort_array(_numbered(order)), lambda s: let(picked(s), _tuples))),
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either fingerprint whose tuples agree, 0 to 1."""

    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, _TUPLE_BITS))

    filled = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(filled > 0, F.size(F.array_intersect(a, b)) / filled).otherwise(F.lit(1.0)).cast("double")


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits for each filled bin."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def next_documents(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id, and after the smallest the largest.

    Ids are range-partitioned and looked up inside a partition; only one row per partition meets in one task.
    """
    parts = materialized(
        ids.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    )
    edges = parts.groupBy("part").agg(F.max("doc_id").alias("largest"))
    all_parts = Window.partitionBy(F.lit(1))
    edges = edges.select(
        "part", F.coalesce(F.lag("largest").over(all_parts.orderBy("part")), F.max("largest").over(all_parts)).alias("before")
    )
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return parts.withColumn("inside", inside).join(edges, "part").select("doc_id", F.coalesce("inside", "before").alias("next_id"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has the last half of the characters replaced by the first as many (or all) of the next document in
    descending doc_id.  Null texts count as empty.  Rows that share a doc_id each get a row; the next document is then
    the row with the smallest text hash.  A row without doc_id has no next document: its text is only cut, and its
    likeness to the next is null.  An empty table gives no rows; columns beside doc_id and text are left out.
    """
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    docs = docs.select("doc_id", text_of().alias("text"))
    # dealt out once: both sides of the join below take the same exchange
    base = docs.filter("doc_id is not null").repartition("doc_id").withColumn("copy", F.row_number().over(same))
    sizes = docs.select("doc_id", F.length(text_of()).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    links = materialized(next_documents(docs).join(sizes, "doc_id"))
    donors = links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("receiver"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    heads = base.filter(F.col("copy") == 1).join(donors, "doc_id").select("receiver", F.col("doc_id").alias("next_id"), F.expr("left(text, need)").alias("head"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - half)"), F.expr("left(coalesce(head, ''), half)"))
    alone = docs.filter("doc_id is null").select("doc_id", "text", F.lit(1).alias("copy"))
    rows = (
        base.join(heads, F.col("doc_id") == F.col("receiver"), "left").drop("receiver")
        .unionByName(alone, allowMissingColumns=True)
        .select("doc_id", "copy", "next_id", "text", "head", n.cast("int").alias("n_chars"), half.alias("half"))
        .select("doc_id", "copy", "next_id", "n_chars", "text", edited.alias("edited"))
        .select(
            "doc_id", "copy", "next_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            fingerprint(F.col("text")).alias("own"), fingerprint(F.col("edited")).alias("other"),
        )
    )
    rows = materialized(rows)
    following = rows.filter(F.col("copy") == 1).select(F.col("doc_id").alias("next_id"), F.col("own").alias("following"))
    near = (
        rows.join(following, "next_id", "left")
        .withColumn("near_next", F.when(F.col("following").isNotNull(), likeness(F.col("own"), F.col("following"))))
    )
    return near.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), "near_next",
    )
