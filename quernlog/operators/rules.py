"""Signature rules over events and entities, all rules in one pass."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlog.data.rules import ALL_RULES, ENTITY_RULES, EVENT_RULES
from quernlog.functions.fields import computed_once, promote
from quernlog.operators.findings import SNIPPET_CHARS
from quernlog.session import materialized

SUFFIXES = {"_contains": "contains", "_prefix": "prefix", "_eq": "eq", "_endswith": "endswith"}
KEY = ["case_id", "source_id", "line_no", "rule_id"]
#: Line numbers of a source that are counted together when a cut-off is looked for.
PIECE = 4096
#: Needles of one mask; a mask is a long and its sign stays out of it.
MASK_BITS = 62
HIT_COLUMNS = [
    "case_id", "source_id", "line_no", "rule_id", "severity", "matched_field", "matched_value", "snippet",
    "ts", "evidence_grade",
]


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    needles: tuple[str, ...]


def conditions(rule: dict) -> list[Condition]:
    default = "eq" if rule["target"] == "entity" else "contains"
    out = []
    for key, values in rule["match"].items():
        op = default
        for suffix, name in SUFFIXES.items():
            if key.endswith(suffix):
                key, op = key[: -len(suffix)], name
                break
        out.append(Condition(key, op, tuple(str(v).lower() for v in values)))
    return out


def by_field_of(conds: list[Condition]) -> dict[str, list[Condition]]:
    """Conditions by field in the order the fields are named; those of one field are alternatives."""
    out: dict[str, list[Condition]] = {}
    for cond in conds:
        out.setdefault(cond.field, []).append(cond)
    return out


def _text(field: str) -> Column:
    return F.lower(F.col("raw" if field == "raw" else f"f_{field}"))


def _any_bit(parts: list[str]) -> str:
    """Bitwise OR of masks as a balanced tree, written as SQL: one call instead of one for each."""
    while len(parts) > 1:
        parts = [f"({' | '.join(parts[i : i + 2])})" for i in range(0, len(parts), 2)]
    return parts[0]


class NeedleLedger:
    """The needles of some rules, each with a bit in a mask of its field.

    One regular expression per field and kind of test finds, at every place of the field's lower-cased text, the longest
    needle that stands there; a constant map turns it into its bits and those of the needles it begins with.  Rules are
    decided on the masks alone, each with a bit in a mask of rules: alternatives of a field by one AND with a constant,
    fields by all of them being met.  Only rows with a rule's bit meet the constant table that names needles and rules.
    """

    def __init__(self, picked: list[dict]):
        self.rules = [(r, by_field_of(conditions(r))) for r in picked]
        self.fields = list(dict.fromkeys(f for _, groups in self.rules for f in groups))
        self.bits: dict[str, dict[tuple[str, str], int]] = {f: {} for f in self.fields}
        for _, groups in self.rules:
            for field, group in groups.items():
                for c in group:
                    for needle in c.needles:
                        self.bits[field].setdefault((c.op, needle), len(self.bits[field]))
        self.words = [(f, w) for f in self.fields for w in range(-(-len(self.bits[f]) // MASK_BITS))]
        self.tests = [(f, op) for f in self.fields for op in dict.fromkeys(op for op, _ in self.bits[f])]

    def found(self) -> dict[str, Column]:
        """The needles found by each test; those that another found needle begins with are left to :meth:`masks`."""
        out = {}
        for i, (field, op) in enumerate(self.tests):
            if op == "eq":
                out[f"_f{i}"] = F.array(_text(field))
                continue
            needles = sorted((n for o, n in self.bits[field] if o == op), key=len, reverse=True)
            body = "|".join(f"\\Q{n}\\E" for n in needles)
            pattern = {"contains": f"(?=({body}))", "prefix": f"^(?=({body}))", "endswith": f"(?=((?:{body})\\z))"}[op]
            out[f"_f{i}"] = F.regexp_extract_all(_text(field), F.lit(pattern), F.lit(1))
        return out

    def masks(self) -> dict[str, Column]:
        """One mask per field and ``MASK_BITS`` of its needles, from :meth:`found`; an absent or empty field holds none."""
        out = {}
        for m, (field, word) in enumerate(self.words):
            parts = []
            for i, (f, op) in enumerate(self.tests):
                if f != field:
                    continue
                needles = [n for o, n in self.bits[f] if o == op]
                held: dict[str, int] = {}
                for n in needles:
                    inside = [n] if op in ("eq", "endswith") else [x for x in needles if n.startswith(x)]
                    for x in inside:
                        k = self.bits[f][op, x]
                        if k // MASK_BITS == word:
                            held[n] = held.get(n, 0) | 1 << (k % MASK_BITS)
                if held:
                    # folded to one literal when the plan is optimized
                    table = json.dumps(held).replace("\\", "\\\\").replace("'", "\\'")
                    table = f"from_json('{table}', 'map<string,bigint>')"
                    parts.append(f"aggregate(_f{i}, 0L, (a, x) -> a | coalesce(try_element_at({table}, x), 0L))")
            out[f"_m{m}"] = F.coalesce(F.expr(_any_bit(parts)), F.lit(0).cast("bigint"))
        return out

    def _alternatives(self, field: str, group: list[Condition]) -> list[dict]:
        """Needles of a rule's field in the order they are named, with the mask and bit of each."""
        places = [(n, self.bits[field][c.op, n]) for c in group for n in c.needles]
        return [{"needle": n, "mask": self.words.index((field, k // MASK_BITS)), "bit": 1 << (k % MASK_BITS)} for n, k in places]

    def _holds(self, groups: dict[str, list[Condition]]) -> str:
        met = []
        for field, group in groups.items():
            wanted: dict[int, int] = {}
            for a in self._alternatives(field, group):
                wanted[a["mask"]] = wanted.get(a["mask"], 0) | a["bit"]
            met.append(f"{_any_bit([f'(_m{m} & {bits}L)' for m, bits in wanted.items()])} <> 0")
        return " AND ".join(met)

    def decided(self) -> dict[str, Column]:
        """Masks of the rules that hold, from :meth:`masks`, and those as an array."""
        out = {}
        for word in range(-(-len(self.rules) // MASK_BITS)):
            mine = self.rules[word * MASK_BITS : (word + 1) * MASK_BITS]
            tests = [f"CASE WHEN {self._holds(g)} THEN {1 << k}L ELSE 0L END" for k, (_, g) in enumerate(mine)]
            out[f"_r{word}"] = F.expr(_any_bit(tests))
        return out | {"_masks": F.array(*[f"_m{m}" for m in range(len(self.words))])}

    def hits(self) -> Column:
        """Array of (rule_id, severity, matched_field, matched_value) of the rules that hold, from :meth:`decided`."""
        rows = []
        for k, (rule, groups) in enumerate(self.rules):
            field, group = next(iter(groups.items()))
            rows.append(
                {"word": k // MASK_BITS, "bit": 1 << (k % MASK_BITS), "rule_id": rule["id"], "severity": rule["severity"],
                 "matched_field": field, "needles": self._alternatives(field, group)}
            )
        # folded to one literal when the plan is optimized
        table = F.from_json(
            F.lit(json.dumps(rows)),
            "array<struct<word:int,bit:long,rule_id:string,severity:string,matched_field:string,"
            "needles:array<struct<needle:string,mask:int,bit:long>>>>",
        )
        words = F.array(*self.rule_masks())
        held = F.filter(table, lambda r: F.get(words, r["word"]).bitwiseAND(r["bit"]) != 0)

        def named(rule: Column) -> Column:
            found = F.filter(rule["needles"], lambda n: F.get(F.col("_masks"), n["mask"]).bitwiseAND(n["bit"]) != 0)
            return F.struct(
                rule["rule_id"].alias("rule_id"), rule["severity"].alias("severity"),
                rule["matched_field"].alias("matched_field"), F.get(found, F.lit(0))["needle"].alias("matched_value"),
            )

        return F.transform(held, named)

    def rule_masks(self) -> list[str]:
        return [f"_r{word}" for word in range(-(-len(self.rules) // MASK_BITS))]


def event_rule_hits(events: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Every (event, rule) match of the event rules.

    Conditions on one field are alternatives, different fields must all hold; ``matched_value`` is the first alternative
    of the first field that holds.  The event table is read once for all rules, see :class:`NeedleLedger`.
    """
    ledger = NeedleLedger([r for r in (EVENT_RULES if rules is None else rules) if r["target"] != "entity"])
    rows = promote(events.filter(F.col("kind") == "event"), sorted(set(ledger.fields) - {"raw"}))
    for step in (ledger.found, ledger.masks, ledger.decided):
        rows = computed_once(rows, step())
    rows = rows.filter(f"{_any_bit(ledger.rule_masks())} <> 0")
    return rows.select(
        "case_id", "source_id", "line_no", "ts", F.left("raw", F.lit(SNIPPET_CHARS)).alias("snippet"), F.explode(ledger.hits()).alias("_hit")
    ).select(
        "case_id", "source_id", "line_no", "_hit.rule_id", "_hit.severity", "_hit.matched_field", "_hit.matched_value",
        "snippet", "ts", F.lit("suspect").alias("evidence_grade"),
    )


def _entity_condition(group: list[Condition]) -> Column:
    """First alternative that holds on the entity column, NULL when none does."""
    text = F.lower(group[0].field)
    tests = {
        "eq": lambda n: text == n,
        "prefix": lambda n: F.startswith(text, F.lit(n)),
        "endswith": lambda n: F.endswith(text, F.lit(n)),
        "contains": lambda n: F.contains(text, F.lit(n)),
    }
    return F.coalesce(*[F.when(tests[c.op](n), F.lit(n)) for c in group for n in c.needles], F.lit(None).cast("string"))


def entity_rule_hits(entities: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Entity rules: row by row, or per canonical key when a rule asks for several hosts."""
    picked = [r for r in (ENTITY_RULES if rules is None else rules) if r["target"] == "entity"]
    single = [r for r in picked if r["min_hosts"] < 2]
    shared = [r for r in picked if r["min_hosts"] >= 2]
    parts = []

    def tagged(rows: DataFrame, chosen: list[dict]) -> DataFrame:
        verdicts = []
        for r in chosen:
            conds = conditions(r)
            values = [_entity_condition(group) for group in by_field_of(conds).values()]
            ok = F.lit(True)
            for v in values:
                ok = ok & v.isNotNull()
            verdicts.append(
                F.when(
                    ok,
                    F.struct(
                        F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"),
                        F.lit(conds[0].field).alias("matched_field"), values[0].alias("matched_value"),
                        F.lit(r["min_hosts"]).alias("min_hosts"),
                    ),
                )
            )
        return rows.select("*", F.inline(F.array_compact(F.array(*verdicts))))

    def shaped(rows: DataFrame) -> DataFrame:
        text = F.concat(F.col("raw_value"), F.lit(" ("), F.col("canonical_key"), F.lit(")"))
        return rows.select(
            "case_id", "source_id", "line_no", "rule_id", "severity", "matched_field", "matched_value",
            F.left(text, F.lit(SNIPPET_CHARS)).alias("snippet"),
            F.lit(None).cast("timestamp").alias("ts"), F.lit("suspect").alias("evidence_grade"),
        )

    if single:
        parts.append(shaped(tagged(entities, single)))
    if shared:
        # only identities that are the same everywhere can be compared across hosts
        rows = entities.filter((F.col("qualifier") == "global") & (F.coalesce("host", F.lit("")) != ""))
        per_host = tagged(rows, shared).groupBy("case_id", "rule_id", "severity", "min_hosts", "canonical_key", "host").agg(
            F.min(F.struct("source_id", "line_no", "raw_value")).alias("_first")
        )
        grouped = (
            per_host.groupBy("case_id", "rule_id", "severity", "min_hosts", "canonical_key")
            .agg(F.count(F.lit(1)).alias("_hosts"), F.min("_first").alias("_first"))
            .filter(F.col("_hosts") >= F.col("min_hosts"))
            .select("*", "_first.*")
            .withColumns({"matched_field": F.lit("canonical_key"), "matched_value": F.col("canonical_key")})
        )
        parts.append(shaped(grouped))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    rows = [(r["id"], r["severity"], r["title"], r["target"], r["max_hits"]) for r in (rules or ALL_RULES)]
    return spark.createDataFrame(rows, "rule_id string, severity string, title string, target string, max_hits int")


def with_outcome(hits: DataFrame, existing: DataFrame | None, cap: int | dict[str, int] | None = None) -> DataFrame:
    """Mark each match 'new', 'dup' (already stored) or, where the caller asks for a cap, 'truncated'.

    ``cap`` is one number of new matches for every rule, or a number for some rules; without it every match
    counts.  The matches are computed once and kept, events are not scanned again.  The place of the cap-th new
    row is the cut-off every other row is compared with.  It is found from counts of pieces of a source; only
    the piece it falls into is ranked, so no rule's matches are gathered anywhere, whatever the cap.
    """
    if existing is None:
        flagged = hits.withColumn("_new", F.lit(True))
    else:
        known = existing.select(*KEY).distinct().withColumn("_known", F.lit(True))
        flagged = hits.join(known, KEY, "left").withColumn("_new", F.col("_known").isNull()).drop("_known")
    if cap is None:
        return flagged.withColumn("outcome", F.when(F.col("_new"), "new").otherwise("dup")).drop("_new")
    if isinstance(cap, int):
        limit = F.lit(cap)
    else:
        limit = F.lit(None).cast("bigint")
        for rule_id, value in cap.items():
            limit = F.when(F.col("rule_id") == rule_id, value).otherwise(limit)
    flagged = materialized(flagged)
    place = F.struct("source_id", "line_no")
    rule, piece = ["case_id", "rule_id"], (F.col("line_no") / PIECE).cast("bigint").alias("_piece")
    new = flagged.filter("_new").select(*KEY, piece)
    before = Window.partitionBy(*rule).orderBy("source_id", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        new.groupBy(*rule, "source_id", "_piece").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_limit", limit)
        .filter((F.col("_before") < F.col("_limit")) & (F.col("_limit") <= F.col("_before") + F.col("_n")))
    )
    ranked = Window.partitionBy(*rule).orderBy("line_no")
    cutoff = (
        new.join(crossing, [*rule, "source_id", "_piece"])
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") + F.col("_before") == F.col("_limit"))
        .select(*rule, place.alias("_cut"))
    )
    return (
        flagged.join(cutoff, rule, "left")
        .withColumn(
            "outcome",
            F.when(F.col("_cut").isNotNull() & (place > F.col("_cut")), "truncated")
            .when(F.col("_new"), "new")
            .otherwise("dup"),
        )
        .drop("_new", "_cut")
    )


def scan_summary(outcomes: DataFrame, scanned: DataFrame, rules: DataFrame) -> DataFrame:
    """Per rule: events offered, new, dup and truncated matches; silent rules are listed with zeros."""
    counts = outcomes.groupBy("rule_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(a) for o, a in (("new", "hits_new"), ("dup", "hits_dup"), ("truncated", "truncated"))]
    )
    total = scanned.select(F.count(F.lit(1))).scalar()
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("hits_new", "hits_dup", "truncated")]
    return rules.select("rule_id").join(counts, "rule_id", "left").select(
        "rule_id", total.alias("scanned"), *filled
    )
