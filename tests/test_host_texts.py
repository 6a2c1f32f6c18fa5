"""Settings and process listings of Linux hosts, and the rules that fire on them."""

import json

from pyspark.sql import functions as F

from quernlog.operators.rules import event_rule_hits
from quernlog.sources import host_texts
from quernlog.sources.records import to_events


def got(df):
    rows = df.withColumn("norm", F.to_json("norm")).orderBy("line_no").collect()
    return [json.loads(r.norm) if r.kind == "event" else None for r in rows]


def test_deleted_programs_and_memory_files(lines):
    rows = got(host_texts.parse_deleted_programs(lines([
        "/proc/12/exe -> /usr/bin/x y (deleted)", "", "/proc/12/exe -> (deleted)", "/proc/12/cwd -> /x (deleted)", "/proc/12/exe -> /x(deleted)",
    ])))
    assert rows == [{"source": "proc_exe_deleted", "pid": "12", "exe": "/usr/bin/x y"}, None, None, None, None]
    rows = got(host_texts.parse_memory_files(lines(["l /proc/3/fd/4 -> /memfd:a (deleted)", "/proc/3/fd/x -> /memfd:a (deleted)", "/proc/3/fd/4 -> /tmp/a (deleted)"])))
    assert rows == [{"source": "proc_fd_memfd", "pid": "3", "fd": "4", "memfd_name": "a"}, None, None]


def test_maps_and_listings(lines):
    rows = got(host_texts.parse_process_maps(lines(["/proc/1/maps:00a-0ff rwxp 0 0:0 0 (deleted)", "/proc/1/maps:00a-0ff rwxp 0 0:0 0 /x y(deleted)", "/proc/1/maps:zz rwxp 0 0 0 /x"])))
    assert [r and r["path"] for r in rows] == ["(deleted)", "/x y", None] and rows[1]["deleted"] == "true"
    rows = got(host_texts.parse_scratch_listing(lines([
        "== /tmp ==", "总用量 4", "drwxr-xr-x 2 u g 4 Jan 1 1:00 .", "lrwxrwxrwx 1 u g 4 Jan 1 1:00 a -> b -> c", "====", "-rw-r--r-- 1 u g 4 Jan 1 1:00 README.zip", "short line",
    ]), chunk=2))
    assert rows[3] == {"source": "shm_tmp_listing", "name": "b", "mode": "lrwxrwxrwx", "owner": "u", "is_symlink": "true", "link_target": "c", "dir": "/tmp"}
    assert rows[5]["size"] == "4" and rows[5]["is_dir"] == "false" and "dir" not in rows[5]
    assert [r is None for r in rows] == [True, True, True, False, True, False, True]


def test_unit_files_and_fragments(lines):
    text = ["[Unit]", "Description=a = b", "; note", "[Service]", "ExecStart=/bin/a \\", "# not a note", "ExecStart = /bin/b", "noise", "[Timer]", "OnCalendar=daily", "Type=x \\"]
    unit = got(host_texts.parse_units(lines(text, "etc/systemd/a.service"), chunk=3))[0]
    assert unit == {
        "source": "a.service", "unit": "a.service", "sections": ["Service", "Timer", "Unit"], "description": "a = b",
        "exec_start": "/bin/a # not a note\n/bin/b", "on_calendar": "daily",
    }
    part = got(host_texts.parse_units(lines(text, "x.d/o.conf"), drop_in=True, chunk=3))[0]
    assert part["exec_start"] == "/bin/a \\\n/bin/b" and part["drop_in"] == "true" and "description" not in part
    assert part["directives_text"].split("\n")[0] == "Unit.Description=a = b"
    bare = host_texts.parse_units(lines(["x" * 3000, "no settings"])).collect()
    assert [(r.kind, len(r.raw), r.norm.sections) for r in bare] == [("event", 2000, [])]
    assert host_texts.parse_units(lines([])).count() == 0


def test_shell_settings(lines):
    row = got(host_texts.parse_shell_settings(lines(["export LD_PRELOAD=/x", "alias  a=b=c", "alias = x", "aliasing=1", "echo a=b"], "p/Persistence/root/.bashrc")))[0]
    assert row == {
        "source": ".bashrc", "file": ".bashrc", "line_count": 5, "non_comment_lines": 5, "owner": "root",
        "exports": "export LD_PRELOAD=/x\naliasing=1", "aliases": "alias  a=b=c",
    }


def test_rules_fire_on_parsed_lines(spark, lines):
    parsed = {
        "linux-pam-exec-hook": (host_texts.parse_authentication_rules, "auth optional pam_exec.so /x", "auth optional pam_unix.so"),
        "linux-udev-exec-shm": (host_texts.parse_device_rules, 'RUN+="/dev/shm/x"', 'NAME="/dev/shm/x"'),
        "linux-systemd-suspicious-path": (host_texts.parse_units, "[Service]\nExecStart=/tmp/x", "[Service]\nExecStart=/usr/bin/x"),
        "linux-ld-preload-export": (host_texts.parse_shell_settings, "export LD_PRELOAD=/x", "# export LD_PRELOAD=/x"),
    }
    for rule, (parse, hit, miss) in parsed.items():
        records = parse(lines(hit.split("\n"), "hit")).unionByName(parse(lines(miss.split("\n"), "miss")))
        sources = spark.createDataFrame([("c", s, "UTC", "t", "t", "h") for s in ("hit", "miss")], "case_id string, source_id string, tz string, log_type string, artifact_type string, host string")
        found = event_rule_hits(to_events(records, sources)).filter(F.col("rule_id") == rule).collect()
        assert [r.source_id for r in found] == ["hit"], rule
