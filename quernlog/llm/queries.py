"""Queries of the corpus operators: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.llm import (
    bpe_chunks,
    epsilon_grid,
    fair_mixing,
    language_id,
    line_templates,
    lm_difference,
    ngram_jaccard,
    order_minhash,
    periodic_runs,
    rule_ensemble,
    rule_ledger,
    spelling_variants,
    unigram_counts,
)
from quernlog.llm.native import documents, text_of
from quernlog.session import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_RULE_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), lines as (
  select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from w
), grams as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from grams) where n > 1
), covered as (
  select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from twice) group by doc_id
), m as (
  select doc_id, len(w) n_words, len(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines,
    coalesce(n, 0) n_repeat_words, len(ls) n_lines, len(regexp_replace(t, '[^!]+', '', 'g')) n_exclamations,
    len(regexp_replace(t, '[^A-Z]+', '', 'g')) n_capitals
  from w join lines using (doc_id) left join covered using (doc_id)
), b as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
    + 4 * (100 * n_symbols > 20 * n_words)::bigint + 8 * (100 * n_exclamations > 20 * n_words)::bigint
    + 16 * (100 * n_capitals > 40 * word_chars)::bigint
    + 32 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint
    + 64 * (100 * n_dup_lines > 50 * n_lines)::bigint fail_bits
  from m
)
select *, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept from b
"""


@query("op10_rule_ledger", _RULE_SQL)
def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(documents(spark, sf_dir)), "base-1")
    rows = rows.withColumn("base_failed", ~rows["kept"])
    return rule_ledger.apply_policy(rows, "strict-1")


_ABLATION_SQL = _RULE_SQL.replace("select *, fail_bits & 3 <> 0 base_failed, fail_bits = 0 kept from b\n", "") + """
, r as (
  select unnest(['few_words', 'repeated_words', 'symbols', 'exclamations', 'capitals', 'word_length', 'duplicate_lines']) rule,
    unnest([1, 2, 4, 8, 16, 32, 64]) bit
)
select rule, count_if(fail_bits & bit <> 0)::bigint n_failed, count_if(fail_bits = bit)::bigint n_only_this,
  count_if(fail_bits & ~bit = 0)::bigint n_kept_without
from b, r group by rule
"""


@query("rule_ledger_ablation", _ABLATION_SQL)
def rule_ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy changes, from the bits of the whole ledger."""
    return rule_ledger.ablation(rule_ledger.ledger(documents(spark, sf_dir)), "strict-1")


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = language_id.fold("doc_id", 5) == 0
    model = language_id.fit(docs, held_out)
    rows = language_id.identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op2_order_minhash")
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_pairs(documents(spark, sf_dir))


@query("op3_unigram_counts")
def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count(documents(spark, sf_dir))


@query("op4_lm_difference")
def op4_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0")
    return lm_difference.score(docs, lm_difference.fit(docs, good))


_MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents
), s as (
  select source, sum(size)::bigint source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] weight
  from d group by source
), f as (
  select *, 2 * source_size / weight fill, sum(source_size) over () * 150 / 100 budget from s
), l as (
  select *, (budget - coalesce(sum(2 * source_size) over u, 0)) / (sum(weight) over () - coalesce(sum(weight) over u, 0)) lev
  from f window u as (order by fill, source nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, budget,
    case when fill <= lv then 2.0::double * source_size else weight * lv end target
  from (select *, (select arg_min(lev, fill) from l where fill > lev) lv from l)
), e as (
  select doc_id, d.source, size, p, source_size, target, budget,
    ('0x' || substr(md5('mix:' || doc_id || ':1:' || p), 1, 15))::bigint place
  from d join t on d.source is not distinct from t.source, (select unnest([0, 1]) p)
), c as (
  select *, sum(size) over (partition by source order by p, place, doc_id rows unbounded preceding) / target finish from e
), g as (
  select *, sum(size) over (order by finish, place, doc_id, p rows unbounded preceding) <= budget fits from c
)
select doc_id, first(size) size, first(source_size) source_size, first(target) target,
  sum(case when fits then size else 0 end)::bigint taken, sum(fits::int)::bigint times
from g group by doc_id
"""


@query("op5_fair_mixing", _MIX_SQL)
def op5_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "times")


@query("op6_rule_ensemble")
def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = materialized(rule_ensemble.with_statistics(documents(spark, sf_dir).select("doc_id", "text")))
    held_out = language_id.fold("doc_id", 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensemble = rule_ensemble.fit(statistics.filter(~held_out), labels)
    return rule_ensemble.score(statistics, ensemble).select("doc_id", held_out.alias("held_out"), "score", "predicted")


_JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w from documents
), g as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) i from w where len(w) > 0)
), n as (
  select doc_id, count(*) n from g group by doc_id
), links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) common from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * common >= 90 * (p.n + q.n - common)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select w.doc_id, coalesce(n, 0)::bigint n_shingles, least(w.doc_id, coalesce(lowest, w.doc_id)) component_id
from w left join n using (doc_id) left join (select a, min(b) lowest from reach group by a) on a = w.doc_id
"""


@query("op7_ngram_jaccard", _JACCARD_SQL)
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(documents(spark, sf_dir), size=3, percent=90)


@query("op8_bpe_chunks")
def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.digests(documents(spark, sf_dir))


@query("op9_line_templates")
def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_templates.without_recurring(documents(spark, sf_dir).select("doc_id", "text"), whole=True)
    return rows.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = periodic_runs.collapse(docs.select("doc_id", periodic_runs.repeated("doc_id", text_of()).alias("text")))
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-(r.length.cast("decimal(20,0)") / r.period.cast("decimal(20,0)"))).alias("e"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("lines", lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc_table() -> list[int]:
    """CRC-32 of every byte, by the polynomial's rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


# letters beyond ASCII stand as one byte each where edits are counted, as SQL's edit distance counts bytes
_BEYOND = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = "".join(c for c in map(chr, range(33, 127)) if not ("a" <= c <= "z") and c != "'")[: len(_BEYOND)]
_SPELLING_SQL = rf"""
with recursive o as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-zÀ-ÿ]+')) w from documents
), d as (
  select doc_id, w, count(*) c from o group by all
), b as (
  select *, flatten(list_transform(list_transform(string_split(doc_id || ':' || w, ''), lambda x: unicode(x)),
    lambda u: case when u < 128 then [u::bigint] else [195, u::bigint - 64] end)) bytes from d
), h as (
  select *, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::bigint),
    4294967295::bigint) h from b, (select {_crc_table()}::bigint[] tab)
), e as (
  select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word, c from h
), v as (
  select word, sum(c)::bigint n, length(word) l, translate(word, '{_BEYOND}', '{_STAND_INS}') plain
  from e where length(word) >= 6 group by word having sum(c) >= 5
), near as (
  select a.word, a.n, b.word near, b.n m from v a join v b on b.l = a.l and a.word <> b.word where levenshtein(a.plain, b.plain) = 1
  union all select a.word, a.n, b.word, b.n from v a join v b on b.l = a.l + 1 where levenshtein(a.plain, b.plain) = 1
  union all select a.word, a.n, b.word, b.n from v a join v b on b.l = a.l - 1 where levenshtein(a.plain, b.plain) = 1
), best as (
  select word, count(*) n_near, max(m) m, first(near order by m desc, near) near from near group by word
), f as (
  select v.word, n, coalesce(n_near, 0)::bigint n_near, case when m >= 5 * n then near end form, case when m >= 5 * n then m end form_n
  from v left join best using (word)
), r(word, reached) as (
  select word, coalesce(form, word) from f union select r.word, f.form from r join f on f.word = r.reached where f.form is not null
)
select f.word, form, root, n, n_near, form_n
from f join (select r.word, max_by(reached, g.n) root from r join f g on g.word = reached group by r.word) z on z.word = f.word
"""


@query("op12_spelling_variants", _SPELLING_SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants.occurrences(documents(spark, sf_dir).select("doc_id", "text"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    words = found.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("word")).alias("word"))
    return spelling_variants.variants(spelling_variants.counted(words))


_NEAR_SQL = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
), u as (
  select vec_id, e from v
  where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), links as (
  select x.vec_id a, y.vec_id b from u x join u y on x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_cosine_similarity(x.e, y.e) >= 0.95
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), n as (select a, count(*) n from links group by a), c as (select a, min(b) c from reach group by a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(c, vec_id)) component_id,
  vec_id = least(vec_id, coalesce(c, vec_id)) kept
from v left join n on n.a = vec_id left join c on c.a = vec_id
"""


@query("op13_epsilon_grid", _NEAR_SQL)
def op13_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = epsilon_grid.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.95)
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
