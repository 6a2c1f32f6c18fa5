"""Address tests on strings with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
V4_PATTERN = f"^{_QUAD}$"
_V6_PATTERN = rf"^[0-9a-fA-F:]*:[0-9a-fA-F:]*({_QUAD})?$"

# Protocol constants: ranges that identify no machine, and ranges without public meaning.
_V4_NONE = r"^(0\.0\.0\.0$|22[4-9]\.|23[0-9]\.|255\.255\.255\.255$)"
_V4_PRIVATE = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
_V6_NONE = r"^(::$|ff[0-9a-f]{2}:)"
_V6_PRIVATE = r"^(::1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an intermediate value so that its expression is written and evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_v4(text: Column) -> Column:
    """Dotted quad, octets 0-255, no leading zeros."""
    return text.rlike(V4_PATTERN)


def _tail_as_groups(text: Column) -> Column:
    """A trailing dotted quad rewritten as two hexadecimal groups."""

    def rewrite(octets: Column) -> Column:
        def byte(i: int) -> Column:
            return F.lpad(F.lower(F.hex(F.get(octets, F.lit(i)).try_cast("int"))), 2, "0")

        return F.concat(
            F.regexp_replace(text, r"[0-9.]+$", ""), byte(0), byte(1), F.lit(":"), byte(2), byte(3)
        )

    return F.when(
        text.contains("."), let(F.split(F.regexp_extract(text, r"([0-9.]+)$", 1), r"\."), rewrite)
    ).otherwise(text)


def _expand(plain: Column) -> Column:
    """Eight groups without leading zeros, NULL when the text is not well formed."""

    def groups(halves: Column) -> Column:
        def part(i: int) -> Column:
            return F.filter(
                F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != ""
            )

        def pad(pair: Column) -> Column:
            gap = F.lit(8) - F.size(pair["head"]) - F.size(pair["rest"])
            whole = F.concat(
                pair["head"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), pair["rest"]
            )
            fits = F.when(F.size(halves) == 2, gap >= 1).otherwise(gap == 0)
            return F.when(fits & (F.size(halves) <= 2), whole)

        return let(F.struct(part(0).alias("head"), part(1).alias("rest")), pad)

    valid = ~plain.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}")
    return F.when(
        valid,
        F.transform(let(F.split(plain, "::"), groups), lambda g: F.regexp_replace(g, "^0+(?=.)", "")),
    )


def _spell(groups: Column) -> Column:
    """Canonical spelling: the first longest run of two or more zero groups becomes '::'."""

    def shorten(joined: Column) -> Column:
        out = None
        for run in range(8, 1, -1):
            zeros = ":" + "0:" * run
            cut = F.regexp_replace(joined, f"^(.*?){zeros}", "$1::")
            out = F.when(joined.contains(zeros), cut) if out is None else out.when(joined.contains(zeros), cut)
        # guard colons go, a leading or trailing '::' stays
        return F.regexp_replace(out.otherwise(joined), "^:(?!:)|(?<!:):$", "")

    def mapped(parts: Column) -> Column:
        def halves(i: int) -> tuple[Column, Column]:
            number = F.conv(F.get(parts, F.lit(i)), 16, 10).cast("int")
            return F.floor(number / 256).cast("string"), (number % 256).cast("string")

        a, b = halves(6)
        c, d = halves(7)
        return F.concat(F.lit("::ffff:"), F.concat_ws(".", a, b, c, d))

    def choose(parts: Column) -> Column:
        v4_in_v6 = F.array_join(F.slice(parts, 1, 6), ":") == "0:0:0:0:0:ffff"
        return F.when(v4_in_v6, mapped(parts)).otherwise(
            let(F.concat(F.lit(":"), F.array_join(parts, ":"), F.lit(":")), shorten)
        )

    return let(groups, choose)


def canonical_ip(text: Column) -> Column:
    """Canonical address text, NULL when the text is not an address (or carries a zone)."""
    v6 = let(let(_tail_as_groups(F.lower(text)), _expand), lambda g: F.when(g.isNotNull(), _spell(g)))
    return F.when(text.rlike(V4_PATTERN), text).when(text.rlike(_V6_PATTERN), v6)


def ip_class(canonical: Column) -> Column:
    """'public', 'private' (private, loopback, link-local) or 'none' (unspecified, multicast, broadcast)."""

    def classify(plain: Column) -> Column:
        v4 = F.when(plain.rlike(_V4_NONE), "none").when(plain.rlike(_V4_PRIVATE), "private").otherwise("public")
        v6 = F.when(plain.rlike(_V6_NONE), "none").when(plain.rlike(_V6_PRIVATE), "private").otherwise("public")
        return F.when(plain.isNull(), F.lit(None).cast("string")).when(plain.contains("."), v4).otherwise(v6)

    return let(F.regexp_replace(canonical, r"^::ffff:(?=.*\.)", ""), classify)


def public_ip(text: Column) -> Column:
    """Canonical text of a public address, else NULL."""
    return let(canonical_ip(text), lambda ip: F.when(ip_class(ip) == "public", ip))


def strip_port(text: Column) -> Column:
    """``a.b.c.d:p`` and ``[v6]:p`` lose the port; anything else is unchanged."""
    v4 = F.regexp_extract(text, r"^(\d+\.\d+\.\d+\.\d+):\d{1,5}$", 1)
    v6 = F.regexp_extract(text, r"^\[([^\]]+)\]:\d{1,5}$", 1)
    return F.when(v4 != "", v4).when(v6 != "", v6).otherwise(text)
