"""Built-in line format descriptors.  Fixed values: patterns, field maps and time formats."""

_CATALINA_STAMP = r"\d{2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}:\d{2}\.\d{3}|\d{2}-\d{2} \d{2}:\d{2}:\d{2}"

TOMCAT_CATALINA = {
    "name": "tomcat-catalina", "kind": "regex", "log_type": "app_log",
    "line_regex": (
        rf"^(?P<ts>{_CATALINA_STAMP}) (?P<level>\S+) (?:\[(?P<thread>[^\]]+)\] )?(?P<logger>\S+?)(?: -)? (?P<message>.*)$"
    ),
    "field_map": {"ts": "ts_raw", "level": "level", "logger": "logger", "message": "message"},
    "ts_field": "ts", "ts_formats": ["%d-%b-%Y %H:%M:%S.%f", "%m-%d %H:%M:%S"],
    "start_regex": rf"^(?:{_CATALINA_STAMP}) \S+",
    "max_continuation_lines": 2000, "max_block_bytes": 1_000_000,
}
LINUX_DPKG = {
    "name": "linux-dpkg", "kind": "regex", "log_type": "audit_log",
    "line_regex": r"^(?P<ts>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (?P<action>\S+)(?: (?P<message>.*))?$",
    "field_map": {"ts": "ts_raw", "action": "action", "message": "message"},
    "ts_field": "ts", "ts_formats": ["%Y-%m-%d %H:%M:%S"],
}
PSHISTORY = {
    "name": "pshistory", "kind": "regex", "log_type": "command_history",
    # not a dot: in Java it stops at U+0085 and U+2028 too
    "line_regex": r"^\s*(?P<command>(?P<cmdline>\S(?:[^\n]*\S)?))\s*$",
    "field_map": {"command": "command", "cmdline": "cmdline"},
}
RAW_TEXT = {
    "name": "raw-text", "kind": "regex", "log_type": "generic",
    "line_regex": r"^(?P<message>.*)$", "field_map": {"message": "message"},
}
BUILT_IN = {d["name"]: d for d in (TOMCAT_CATALINA, LINUX_DPKG, PSHISTORY, RAW_TEXT)}
