"""Settings and process listings of Linux hosts: unit files, device rules, authentication rules, deleted and hidden files.

Lines are read by words and positions.  The name of a file is the last part of its ``source_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlog.functions.fields import computed_once
from quernlog.functions.net import let
from quernlog.operators.chunked import CHUNK, with_prefix
from quernlog.sources.records import is_blank, record

# Names of assignments whose value is run.  Fixed values.
UDEV_RUN = ["RUN=", "RUN+=", "RUN:=", "RUN{program}=", "RUN{program}+=", "RUN{program}:="]
UDEV_IMPORT = ["IMPORT{program}="]
UDEV_PROGRAM = ["PROGRAM=", "PROGRAM+=", "PROGRAM:="]
TOTALS = ["total", "总用量"]
# Field: section, key.  Fixed values.
UNIT_LISTS = {
    "exec_start": ("Service", "ExecStart"), "exec_start_pre": ("Service", "ExecStartPre"), "exec_start_post": ("Service", "ExecStartPost"),
    "on_calendar": ("Timer", "OnCalendar"), "wanted_by": ("Install", "WantedBy"), "required_by": ("Install", "RequiredBy"),
}
UNIT_FIRSTS = {"description": ("Unit", "Description"), "type": ("Service", "Type"), "user": ("Service", "User")}

_GONE = "(deleted)"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _split(text: Column, parts: int = -1) -> Column:
    return F.split(_bare(text), r"\s+", parts)


def _flag(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), "true").otherwise("false")


def _at(words: str | Column, i: int) -> Column:
    return F.get(F.col(words) if isinstance(words, str) else words, F.lit(i))


def _digits(text: Column) -> Column:
    return F.coalesce((text != "") & (F.translate(text, "0123456789", "") == ""), F.lit(False))


def _file() -> Column:
    return F.substring_index("source_id", "/", -1)


def _kind(event: Column) -> Column:
    return F.when(F.coalesce(event, F.lit(False)), "event").otherwise("skip")


def _quiet(text: Column) -> Column:
    return is_blank(text) | _bare(text).startswith("#")


# ---- processes ------------------------------------------------------------------------------------


def _process_link(raw: Column) -> Column:
    """``.../proc/<pid>/... -> target (deleted)``: struct of the parts of the link, last first, and the target; else NULL."""

    def cut(text: Column) -> Column:
        place = F.split(text, r"\s+->\s+", 2)
        target = F.regexp_replace(F.left(_at(place, 1), F.length(_at(place, 1)) - len(_GONE)), r"\s+$", "")
        spaced = F.length(target) < F.length(_at(place, 1)) - len(_GONE)
        link = F.reverse(F.split(_at(place, 0), "/"))
        return F.when(_at(place, 1).endswith(_GONE) & spaced & (target != ""), F.struct(link.alias("link"), target.alias("target")))

    return let(_bare(raw), cut)


def parse_deleted_programs(lines: DataFrame) -> DataFrame:
    """Links of running programs whose file is gone: pid and exe."""
    rows = computed_once(lines, {"_p": _process_link(F.col("raw"))})
    link = F.col("_p.link")
    sound = (_at(link, 0) == "exe") & _digits(_at(link, 1)) & (_at(link, 2) == "proc") & _at(link, 3).isNotNull()
    norm = {"source": F.lit("proc_exe_deleted"), "pid": _at(link, 1), "exe": F.col("_p.target")}
    return record(rows, _kind(sound), norm, reason=F.lit("not the link of a deleted program"))


def parse_memory_files(lines: DataFrame) -> DataFrame:
    """Open files that live in memory alone: pid, fd and memfd_name."""
    rows = computed_once(lines, {"_p": _process_link(F.col("raw"))})
    link, target, mark = F.col("_p.link"), F.col("_p.target"), "/memfd:"
    name = F.substr(target, F.lit(len(mark) + 1))
    sound = (
        _digits(_at(link, 0)) & (_at(link, 1) == "fd") & _digits(_at(link, 2)) & (_at(link, 3) == "proc") & _at(link, 4).isNotNull()
        & target.startswith(mark) & (name != "") & ~name.rlike(r"\s")
    )
    norm = {"source": F.lit("proc_fd_memfd"), "pid": _at(link, 2), "fd": _at(link, 0), "memfd_name": name}
    return record(rows, _kind(sound), norm, reason=F.lit("not a deleted memory file"))


def parse_process_maps(lines: DataFrame) -> DataFrame:
    """Executable mappings: pid, range, perms, path, and whether the file is deleted."""
    rows = computed_once(lines, {"_w": _split(F.col("raw"), 6)})
    rows = computed_once(rows, {"_h": F.split(_at("_w", 0), "/"), "_r": F.substring_index(_at("_w", 0), ":", -1)})
    borders = F.split("_r", "-")
    hexadecimal = lambda x: F.coalesce((x != "") & (F.translate(x, "0123456789abcdef", "") == ""), F.lit(False))
    sound = (
        (F.size("_w") == 6) & (F.size("_h") == 4) & (_at("_h", 0) == "") & (_at("_h", 1) == "proc") & _digits(_at("_h", 2))
        & (_at("_h", 3) == F.concat(F.lit("maps:"), "_r")) & (F.size(borders) == 2) & hexadecimal(_at(borders, 0)) & hexadecimal(_at(borders, 1))
    )
    last = _at("_w", 5)
    path = F.when(last.endswith(_GONE) & (last != _GONE), F.regexp_replace(F.left(last, F.length(last) - len(_GONE)), r"\s+$", "")).otherwise(last)
    norm = {
        "source": F.lit("proc_maps_suspicious_exec"), "pid": _at("_h", 2), "range": F.col("_r"), "perms": _at("_w", 1),
        "path": path, "deleted": _flag(F.contains(F.col("raw"), F.lit(_GONE))),
    }
    return record(rows, _kind(sound), norm, reason=F.lit("not a mapping"))


def parse_deleted_files(lines: DataFrame) -> DataFrame:
    """Open files without a name (``lsof +L1``); nine columns, or ten with the node before the name."""
    rows = computed_once(lines, {"_w": _split(F.col("raw"), 10)})
    header = F.ltrim(F.col("raw")).startswith("COMMAND")
    names = ["command", "pid", "user", "fd", "type", None, "size_off", "nlink"]
    norm = {
        "source": F.lit("lsof_deleted_open"), **{n: _at("_w", i) for i, n in enumerate(names) if n},
        "name": F.coalesce(_at("_w", 9), _at("_w", 8)),
    }
    return record(rows, _kind((F.size("_w") >= 9) & ~header), norm, reason=F.lit("header or too few columns"))


def parse_scratch_listing(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ls -la`` of scratch directories; a ``== directory ==`` line names the directory of what follows."""
    text = _bare(F.col("raw"))
    headed = text.startswith("==") & text.endswith("==")
    rows = computed_once(lines, {"_s": F.when(headed, F.btrim(text, F.lit("= "))), "_w": _split(F.col("raw"))})
    rows = with_prefix(rows, ["source_id"], "line_no", lasts={"_dir": F.col("_s")}, size=chunk)
    last = F.element_at("_w", -1)
    total = F.lit(False)
    for word in TOTALS:
        total = total | text.startswith(word)
    entry = F.col("_s").isNull() & ~total & (F.size("_w") >= 9) & ~last.isin(".", "..")
    linked = F.contains(text, F.lit(" -> "))
    target = F.substring_index(text, " -> ", -1)
    left = F.left(text, F.length(text) - F.length(target) - 4)
    norm = {
        "source": F.lit("shm_tmp_listing"), "name": F.when(linked, F.element_at(_split(left), -1)).otherwise(last),
        "mode": _at("_w", 0), "owner": _at("_w", 2), "size": F.when(~linked, _at("_w", 4)),
        "is_dir": F.when(~linked, _flag(_at("_w", 0).startswith("d"))), "is_symlink": _flag(linked),
        "link_target": F.when(linked, _bare(target)), "dir": F.nullif(F.col("_dir"), F.lit("")),
    }
    return record(rows, _kind(entry), norm, reason=F.lit("blank, heading, total or too few columns"))


# ---- settings -------------------------------------------------------------------------------------


def parse_device_rules(lines: DataFrame) -> DataFrame:
    """udev rules: every rule, with the programs that it runs."""
    pieces = F.split("raw", '"')  # names stand before a quotation mark, values between two

    def values(names: list[str]) -> Column:
        def named(piece: Column, i: Column) -> Column:
            hit = F.lit(False)
            for name in names:
                hit = hit | piece.endswith(name)
            return F.when((i % 2 == 0) & (i + 2 < F.size("_q")) & hit, F.get("_q", i + 1))

        return F.array_compact(F.transform("_q", named))

    rows = computed_once(lines, {"_q": pieces})
    rows = computed_once(rows, {"_run": values(UDEV_RUN), "_import": values(UDEV_IMPORT), "_program": values(UDEV_PROGRAM)})

    def joined(column: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, " "))

    norm = {
        "source": _file(), "rule_file": _file(), "raw": _bare(F.col("raw")),
        "has_exec": _flag(F.size("_run") + F.size("_import") + F.size("_program") > 0),
        "run": joined("_run"), "import_program": joined("_import"), "program": joined("_program"),
    }
    return record(rows, _kind(~_quiet(F.col("raw"))), norm, reason=F.lit("blank line or comment"))


def parse_authentication_rules(lines: DataFrame) -> DataFrame:
    """PAM rules: ``type control module [arguments]`` and ``@include target``; a control may be a list in brackets."""
    rows = computed_once(lines, {"_w": _split(F.col("raw"), 2)})
    rest = _at("_w", 1)

    def cut(text: Column) -> Column:
        end = F.locate("]", text)
        after = F.substr(text, end + 1)
        listed = text.startswith("[") & (end > 0) & after.rlike(r"^\s+\S")
        plain = F.split(text, r"\s+", 3)
        control = F.when(listed, F.left(text, end)).otherwise(_at(plain, 0))
        tail = F.when(listed, F.split(_bare(after), r"\s+", 2)).otherwise(F.slice(plain, 2, 2))
        return F.struct(control.alias("control"), tail.alias("tail"))

    rows = computed_once(rows, {"_r": let(rest, cut)})
    include = (_at("_w", 0) == "@include") & rest.isNotNull()
    module = _at("_r.tail", 0)
    kind = _at("_w", 0)
    rule = (kind != "") & (F.translate(kind, "abcdefghijklmnopqrstuvwxyz", "") == "") & module.isNotNull() & (module != "")
    norm = {
        "source": F.lit("pam_d"), "service": _file(), "directive": F.when(include, "@include"),
        "target": F.when(include, _at(F.split(rest, r"\s+", 2), 0)), "type": F.when(~include, kind), "control": F.when(~include, F.col("_r.control")),
        "module": F.when(~include, module), "is_pam_exec": F.when(~include, _flag(F.contains(module, F.lit("pam_exec")))),
        "args": F.when(~include, F.nullif(_at("_r.tail", 1), F.lit(""))),
    }
    event = ~_quiet(F.col("raw")) & F.coalesce(include | rule, F.lit(False))
    return record(rows, _kind(event), norm, reason=F.lit("blank, comment or no rule"))


def directives(lines: DataFrame, continued: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(source_id, line_no, section, key, value) of settings in sections; a backslash at the end goes on, if ``continued``."""
    text = _bare(F.col("raw"))
    rows = computed_once(lines.select("source_id", "line_no", "raw"), {"_text": text, "_open": text.endswith("\\") if continued else F.lit(False)})
    if continued:
        rows = with_prefix(rows, ["source_id"], "line_no", lasts={"_before": F.col("_open")}, size=chunk)
        begins = F.when(F.coalesce("_before", F.lit(False)), 0).otherwise(1)
        rows = with_prefix(rows, ["source_id"], "line_no", sums={"_part": begins}, size=chunk)
        piece = F.when(F.col("_open"), F.left("_text", F.length("_text") - 1)).otherwise(F.col("_text"))
        whole = rows.groupBy("source_id", "_part").agg(
            F.min("line_no").alias("line_no"), F.max(F.struct("line_no", "_open")).alias("_last"),
            F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("no"), piece.alias("piece")))).alias("_pieces"),
        )
        rows = whole.filter(~F.col("_last._open")).select("source_id", "line_no", _bare(F.array_join("_pieces.piece", "")).alias("_text"))
    text = F.col("_text")
    headed = text.startswith("[") & text.endswith("]") & (F.length(text) > 2)
    rows = rows.filter((text != "") & ~text.startswith("#") & ~text.startswith(";"))
    rows = computed_once(rows, {"_head": F.when(headed, F.substr(text, F.lit(2), F.length(text) - 2))})
    rows = with_prefix(rows, ["source_id"], "line_no", lasts={"section": F.col("_head")}, size=chunk)
    at = F.locate("=", text)
    return rows.filter(F.col("_head").isNull() & F.col("section").isNotNull() & (at > 1)).select(
        "source_id", "line_no", "section", _bare(F.left(text, at - 1)).alias("key"), _bare(F.substr(text, at + 1)).alias("value")
    )


def _whole_files(lines: DataFrame, shown: int) -> DataFrame:
    """One row per file: line_no 1, and the first ``shown`` characters as raw."""
    # a line has a character at least, its end
    top = lines.filter(F.col("line_no") <= shown).select("source_id", F.struct("line_no", F.left("raw", F.lit(shown)).alias("raw")).alias("x"))
    files = lines.select("source_id").distinct().join(
        top.groupBy("source_id").agg(F.sort_array(F.collect_list("x")).alias("x")), "source_id", "left"
    )
    return files.select("source_id", F.lit(1).cast("long").alias("line_no"), F.left(F.array_join("x.raw", "\n"), F.lit(shown)).alias("raw"))


def parse_units(lines: DataFrame, drop_in: bool = False, shown: int = 2000, chunk: int = CHUNK) -> DataFrame:
    """One event per unit file, or per fragment that overrides one: what it starts, when, and for whom.

    ``raw`` shows the first ``shown`` characters of the file; all directives count.
    """
    found = directives(lines, not drop_in, chunk)

    def those(section: str, key: str) -> Column:
        return F.when((F.col("section") == section) & (F.col("key") == key), F.struct("line_no", "value"))

    def listed(section: str, key: str) -> Column:
        values = F.sort_array(F.collect_list(those(section, key)))
        return F.when(F.size(values) > 0, F.array_join(values["value"], "\n"))

    lists = {"exec_start": UNIT_LISTS["exec_start"]} if drop_in else UNIT_LISTS
    firsts = {} if drop_in else UNIT_FIRSTS
    every = F.sort_array(F.collect_list(F.struct("line_no", F.concat("section", F.lit("."), "key", F.lit("="), "value").alias("text"))))
    text = {"directives_text": F.array_join(every["text"], "\n")} if drop_in else {}
    made = found.groupBy("source_id").agg(
        F.sort_array(F.collect_set("section")).alias("sections"),
        *[listed(*v).alias(k) for k, v in lists.items()],
        *[F.min(those(*v))["value"].alias(k) for k, v in firsts.items()],
        *[v.alias(k) for k, v in text.items()],
    )
    rows = _whole_files(lines, shown)
    rows = rows.join(made, "source_id", "left")
    norm = {
        "source": _file(), "unit": _file(), "sections": F.coalesce("sections", F.array().cast("array<string>")),
        **{k: F.col(k) for k in (*lists, *firsts)},
    }
    if drop_in:
        norm |= {"drop_in": F.lit("true"), "directives_text": F.coalesce("directives_text", F.lit(""))}
    return record(rows, F.lit("event"), norm)


def parse_shell_settings(lines: DataFrame, shown: int = 2000) -> DataFrame:
    """One event per start file of a shell: all variables it sets and all aliases, and whose it is.

    The owner is named by a path below ``Persistence/home/<name>`` or ``Persistence/root``.
    """
    text = _bare(F.col("raw"))
    name = F.regexp_replace(F.substring_index(text, "=", 1), r"^export\s+", "")
    assigned = F.contains(text, F.lit("="))
    rows = computed_once(lines.select("source_id", "line_no", "raw"), {"_text": text, "_quiet": _quiet(F.col("raw"))})
    rows = computed_once(rows, {
        "_alias": ~F.col("_quiet") & assigned & F.substring_index(text, "=", 1).rlike(r"^alias\s+\S"),
        "_set": ~F.col("_quiet") & assigned & name.rlike(r"^\w+$") & ~name.rlike(r"^\d"),
    })

    def listed(test: Column) -> Column:
        found = F.sort_array(F.collect_list(F.when(test, F.struct("line_no", "_text"))))
        return F.when(F.size(found) > 0, F.array_join(found["_text"], "\n"))

    made = rows.groupBy("source_id").agg(
        F.count("*").alias("line_count"), F.count_if(~F.col("_quiet")).alias("non_comment_lines"),
        listed(F.col("_set") & ~F.col("_alias")).alias("exports"), listed(F.col("_alias")).alias("aliases"),
    )
    rows = computed_once(_whole_files(lines, shown).join(made, "source_id"), {"_path": F.split("source_id", "/")})
    at = F.array_position("_path", F.lit("Persistence")).cast("int")
    place, below = F.when(at > 0, F.get("_path", at)), F.get("_path", at + 1)
    norm = {
        "source": _file(), "file": _file(), "line_count": F.col("line_count"), "non_comment_lines": F.col("non_comment_lines"),
        "owner": F.when(place == "home", below).when((place == "root") & below.isNotNull(), "root"),
        "exports": F.col("exports"), "aliases": F.col("aliases"),
    }
    return record(rows, F.lit("event"), norm)
