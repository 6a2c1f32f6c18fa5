"""Every rule of the catalogue over events made to match it, and over near misses.

Each row of ``events`` becomes one case of the list below: an event that some rules match, or one that misses them by
little.  What must come out is written down by hand next to it and is what the SQL says.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlog.operators import rules
from quernlog.plans.adapters import table
from quernlog.plans.registry import query

PS, CRON = "ps_auxwwf", "cron_sys"

#: (fields, near miss, what the fields match as (rule, severity, field, value)); ``#`` stands for the row's number.
CASES: list[tuple[dict, dict, list[tuple[str, str, str, str]]]] = [
    ({"method": "Delete"}, {"method": "GET", "path": "/delete/#"}, [("abnormal-method", "info", "method", "delete")]),
    ({"query": "a=#&exec=/BIN/sh"}, {"query": "a=#&execute", "path": "cmd="}, [("cmd-exec-params", "high", "query", "exec=")]),
    ({"raw": "GET /a/#/..%2F..%2f"}, {"raw": "GET /a/#/.. /"}, [("path-traversal", "high", "raw", "..%2f")]),
    ({"ua": "Nikto/#"}, {"ua": "nikt o/#", "path": "nikto"}, [("scanner-ua", "medium", "ua", "nikto")]),
    ({"path": "/#/.ENV"}, {"path": "/#/env", "query": "/.env"}, [("sensitive-path", "medium", "path", "/.env")]),
    ({"query": "x=PG_SLEEP#"}, {"query": "x=sleep #"}, [("sqli-time-based", "high", "query", "pg_sleep")]),
    ({"query": "x=#-or 1=1"}, {"query": "x=#-or 1 =1"}, [("sqli-union-select", "high", "query", "or 1=1")]),
    ({"ua": "QianXin Checker #"}, {"ua": "qianxin-checker #"}, [("waf-checker-ua", "info", "ua", "qianxin checker")]),
    ({"path": "/#/WSO.php"}, {"path": "/#/wso.txt"}, [("webshell-filename", "high", "path", "wso.php")]),
    ({"query": "u=JavaScript:#"}, {"query": "u=javascript #"}, [("xss-javascript-protocol", "medium", "query", "javascript:")]),
    ({"query": "u=%3CScript#"}, {"query": "u=%3c script#"}, [("xss-script-handler", "high", "query", "%3cscript")]),
    (
        {"channel": "security", "event_id": 4732, "data": {"SubjectUserSid": "S-1-5-18", "n": "#"}},
        {"channel": "security", "event_id": 4733, "data": {"SubjectUserSid": "S-1-5-18", "n": "#"}},
        [("account-mgmt-system-subject", "medium", "channel", "security")],
    ),
    ({"key_path": "HKLM\\#\\ExtensionInstallForcelist\\1"}, {"key_path": "HKLM\\#\\ExtensionInstall"}, [("browser-extension-forcelist", "medium", "key_path", "extensioninstallforcelist")]),
    ({"local_port": "3389", "state": "ESTABLISHED"}, {"local_port": "33890", "state": "ESTABLISHED"}, [("lateral-admin-port-connection", "medium", "local_port", "3389")]),
    ({"command": "cmd /c NET VIEW #"}, {"command": "cmd /c netview #"}, [("lateral-recon-cmdline", "low", "command", "net view")]),
    ({"exe_name": "psexec.exe"}, {"exe_name": "psexec.exe.#"}, [("lateral-remote-exec-tool-prefetch", "medium", "exe_name", "psexec.exe")]),
    ({"channel": "Security", "event_id": "4698", "data": {"n": "#"}}, {"channel": "System", "event_id": "4698", "data": {"n": "#"}}, [("lateral-remote-task-created", "medium", "channel", "security")]),
    ({"channel": "System", "event_id": "7045", "data": {"p": "c:/#"}}, {"channel": "System", "event_id": "7046", "data": {"p": "c:/#"}}, [("lateral-service-installed", "medium", "channel", "system")]),
    (
        {"channel": "SYSTEM", "event_id": "7045", "data": "C:\\ProgramData\\#.exe"},
        {"channel": "SYSTEM", "event_id": "7044", "data": "C:\\ProgramData\\#.exe"},
        [("lateral-service-installed", "medium", "channel", "system"), ("lateral-service-writable-dir", "high", "channel", "system")],
    ),
    ({"channel": "Security", "event_id": "1102"}, {"channel": "Setup", "event_id": "1102", "data": "#"}, [("ransom-security-log-cleared", "high", "channel", "security")]),
    (
        {"channel": "Security", "event_id": "4688", "data": "wbadmin DELETE CATALOG #"},
        {"channel": "Security", "event_id": "4688", "data": "wbadmin delete the catalog #"},
        [("ransom-shadow-delete-cmdline", "high", "channel", "security")],
    ),
    ({"command": "vssadmin Delete Shadows /for=#"}, {"command": "vssadmin list shadows #"}, [("ransom-shadow-delete-pshistory", "high", "command", "delete shadows")]),
    ({"exe_name": "wbadmin.EXE"}, {"exe_name": "wbadmin"}, [("ransom-shadow-tool-prefetch", "medium", "exe_name", "wbadmin.exe")]),
    (
        {"key_path": "HKCU\\Software\\CurrentVersion\\RunOnce", "data": "C:\\Users\\u#\\a.exe"},
        {"key_path": "HKCU\\Software\\CurrentVersion\\Explorer", "data": "C:\\Users\\u#\\a.exe"},
        [("suspicious-run-key-non-system-dir", "medium", "key_path", "\\currentversion\\run")],
    ),
    ({"command": "bandizip C out#.zip"}, {"command": "bandizip x out#.zip"}, [("exfil-archive-create-cmdline", "medium", "command", "bandizip c")]),
    ({"exe_name": "360Zip.exe"}, {"exe_name": "x360zip.exe"}, [("exfil-compression-tool-prefetch", "low", "exe_name", "360zip.exe")]),
    (
        {"command": "WinRAR a -p# out"}, {"command": "winrar x -p# out"},
        [("exfil-archive-create-cmdline", "medium", "command", "rar a"), ("exfil-encrypted-archive-cmdline", "high", "command", "rar a -p")],
    ),
    ({"remote_port": "21", "state": "Established"}, {"remote_port": "21", "state": "LISTEN"}, [("exfil-transfer-port-outbound", "low", "remote_port", "21")]),
    ({"command": "pscp a# b"}, {"command": "ps cp a# b"}, [("exfil-upload-tool-cmdline", "medium", "command", "pscp")]),
    ({"exe_name": "XMRig.exe"}, {"exe_name": "xmrig"}, [("miner-known-tool-prefetch", "high", "exe_name", "xmrig.exe")]),
    (
        {"remote_port": "14444", "state": "established"}, {"remote_port": "1444", "state": "established"},
        [("miner-pool-port-outbound", "high", "remote_port", "14444")],
    ),
    (
        {"key_path": "HKLM\\System\\Services\\s#", "value_name": "IMAGEPATH", "data": "c:\\tmp\\a.exe"},
        {"key_path": "HKLM\\System\\Services\\s#", "value_name": "ImagePaths", "data": "c:\\tmp\\a.exe"},
        [("miner-service-writable-dir", "medium", "key_path", "\\services\\")],
    ),
    ({"command": "run Stratum+SSL://p#"}, {"command": "run stratum ssl//p#"}, [("miner-stratum-url-cmdline", "high", "command", "stratum+ssl")]),
    ({"command": "m --RandomX #"}, {"command": "m -randomx #"}, [("miner-tool-flags-cmdline", "medium", "command", "--randomx")]),
    ({"state": "syn_sent", "flags": "[UNREPLIED] #"}, {"state": "syn_sent", "flags": "[ASSURED] #"}, [("linux-conntrack-unreplied-out", "low", "state", "syn_sent")]),
    ({"source": CRON, "command": "sh /dev/shm/# x"}, {"source": "cron", "command": "sh /dev/shm/# x"}, [("linux-cron-suspicious-exec", "medium", "source", "cron_sys")]),
    ({"source": "ebury_ioc_libs", "path": "/lib/LIBNS2.so.#"}, {"source": "ebury_ioc_libs", "path": "/lib/libns.so.#"}, [("linux-ebury-libns2", "high", "source", "ebury_ioc_libs")]),
    ({"source": "ldd_sshd", "is_ioc": True}, {"source": "ldd_sshd", "is_ioc": False, "path": "#"}, [("linux-ebury-sshd-lib", "high", "source", "ldd_sshd")]),
    ({"source": "passwd", "empty_password": True, "uid": 1000}, {"source": "passwd", "empty_password": "yes", "uid": 10}, [("linux-empty-password-account", "high", "source", "passwd")]),
    ({"source": PS, "command": "tar -CZ /srv#"}, {"source": PS, "command": "tar -xz /srv#"}, [("linux-exfil-archive-cmdline", "low", "source", "ps_auxwwf")]),
    ({"source": PS, "command": "rsync -a #"}, {"source": PS, "command": "rsyncd#"}, [("linux-exfil-copy-cmdline", "low", "source", "ps_auxwwf")]),
    ({"source": "shm_tmp_listing", "name": "d#.TAR.BZ2"}, {"source": "shm_tmp_listing", "name": "d.tar.bz2.#"}, [("linux-exfil-shmtmp-archive", "medium", "source", "shm_tmp_listing")]),
    ({"source": PS, "command": "lftp #"}, {"source": "ps", "command": "lftp #"}, [("linux-exfil-upload-cmdline", "medium", "source", "ps_auxwwf")]),
    (
        {"remote_port": "22", "state": "ESTABLISHED", "remote_addr": "192.168.0.7"},
        {"remote_port": "22", "state": "ESTABLISHED", "remote_addr": "172.192.168.1"},
        [("linux-lateral-internal-ssh-conn", "low", "remote_port", "22")],
    ),
    (
        {"source": "auth_log", "action": "Accepted", "user": "root", "src_ip": "10.0.0.#"},
        {"source": "auth_log", "action": "failed", "user": "root", "src_ip": "10.0.0.#"},
        [("linux-lateral-root-accepted-authlog", "high", "source", "auth_log"), ("linux-sshd-accepted-authlog", "high", "source", "auth_log")],
    ),
    (
        {"unit": "sshd-session", "action": "accepted", "user": "ROOT", "src_ip": "10.0.0.#"},
        {"unit": "sshd@1", "action": "accepted", "user": "root", "src_ip": "10.0.0.#"},
        [("linux-lateral-root-accepted-journal", "high", "unit", "sshd-session"), ("linux-sshd-accepted-journal", "high", "unit", "sshd-session")],
    ),
    ({"source": PS, "command": "SSH -D #"}, {"source": PS, "command": "ssh -l #"}, [("linux-lateral-tunnel-tool-cmdline", "medium", "source", "ps_auxwwf")]),
    ({"exports": ["PATH", "LD_PRELOAD=/x#"]}, {"exports": ["PATH", "LD_LIBRARY_PATH=/x#"]}, [("linux-ld-preload-export", "high", "exports", "ld_preload")]),
    ({"source": "recovered_binaries", "kind": "memfd"}, {"source": "recovered_binaries", "kind": "memfd:#"}, [("linux-memfd-recovered-binary", "high", "source", "recovered_binaries")]),
    ({"source": PS, "command": "./CPUMiner #"}, {"source": PS, "command": "./cpu-miner #"}, [("linux-miner-known-tool-cmdline", "high", "source", "ps_auxwwf")]),
    ({"dport": 8333}, {"dport": 83330, "sport": 8333}, [("linux-miner-pool-port-conntrack", "medium", "dport", "8333")]),
    (
        {"source": "proc_cmdline_comm_exe_compare", "exe": "/var/tmp/#"}, {"source": "proc_cmdline_comm_exe_compare", "exe": "/var/lib/#"},
        [("linux-miner-proc-exe-writable", "high", "source", "proc_cmdline_comm_exe_compare")],
    ),
    (
        {"source": PS, "command": "m -o stratum://p#"}, {"source": PS, "command": "m -o stratu://p#"},
        [("miner-stratum-url-cmdline", "high", "command", "stratum://"), ("linux-miner-stratum-cmdline", "high", "source", "ps_auxwwf")],
    ),
    ({"is_pam_exec": True}, {"is_pam_exec": "true#"}, [("linux-pam-exec-hook", "medium", "is_pam_exec", "true")]),
    (
        {"source": "lsof_deleted_open", "type": "REG", "nlink": 0, "name": "/v/#"},
        {"source": "lsof_deleted_open", "type": "REG", "nlink": 0, "name": "v/#"},
        [("linux-ransom-deleted-held-file", "low", "source", "lsof_deleted_open")],
    ),
    ({"source": PS, "command": "sudo RM -rf /#"}, {"source": PS, "command": "sudo rm -r /#"}, [("linux-ransom-destructive-cmdline", "high", "source", "ps_auxwwf")]),
    ({"source": "shm_tmp_listing", "name": "HOW_TO_DECRYPT.#"}, {"source": "shm_tmp_listing", "name": "how to decrypt.#"}, [("linux-ransom-note-shmtmp", "high", "source", "shm_tmp_listing")]),
    ({"risk_flags": ["weak_key", "n#"]}, {"risk_flags": ["week_key", "n#"]}, [("linux-ssh-suspicious-authkey", "high", "risk_flags", "weak_key")]),
    (
        {"source": "auth_log", "action": "accepted", "user": "u#", "src_ip": "10.0.0.1"}, {"source": "auth_log", "action": "accepted", "user": "u#", "src_ip": "::1"},
        [("linux-sshd-accepted-authlog", "high", "source", "auth_log")],
    ),
    (
        {"unit": "SSHD", "action": "accepted", "user": "u#", "src_ip": "10.0.0.1"}, {"unit": "sshd", "action": "closed", "user": "u#", "src_ip": "10.0.0.1"},
        [("linux-sshd-accepted-journal", "high", "unit", "sshd")],
    ),
    ({"exec_start": "/Dev/Shm/a#"}, {"exec_start": "/dev/sda#"}, [("linux-systemd-suspicious-path", "high", "exec_start", "/dev/shm")]),
    ({"has_exec": True, "raw": 'RUN+="/dev/shm/#"'}, {"has_exec": True, "raw": 'RUN+="/dev/#/shm"'}, [("linux-udev-exec-shm", "high", "has_exec", "true")]),
    ({"source": "PASSWD", "uid": 0, "empty_password": False}, {"source": "passwd", "uid": "00", "empty_password": False}, [("linux-uid0-account", "medium", "source", "passwd")]),
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXPECTED = ", ".join(
    f"({i}, {', '.join(_quote(v) for v in match)})" for i, (_, _, matches) in enumerate(CASES) for match in matches
)


@query(
    "rule_scan_catalogue",
    f"""WITH x(place, rule_id, severity, matched_field, matched_value) AS (VALUES {_EXPECTED})
SELECT CAST(event_id + 1 AS BIGINT) AS line_no, rule_id, severity, matched_field, matched_value FROM events
JOIN x ON x.place = event_id % {len(CASES)} WHERE event_id % {2 * len(CASES)} < {len(CASES)}""",
)
def scan_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Rows number 0 to n - 1 of every 2 n are hits, the next n near misses; all their values hold the row's number."""

    def texts(which: int) -> list[tuple[str, str]]:
        kept = [dict(case[which]) for case in CASES]
        raw = [str(c.pop("raw", "row #")) for c in kept]
        return [(json.dumps(c | {"note": "row #"}, separators=(",", ":")), r) for c, r in zip(kept, raw)]

    shapes = spark.createDataFrame([(i, f, r) for i, (f, r) in enumerate(texts(0) + texts(1))], "place int, f string, r string")
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % (2 * len(CASES))).cast("int").alias("place"))
    number = F.col("event_id").cast("string")
    events = rows.join(shapes, "place").select(
        F.lit("c1").alias("case_id"), F.lit("s1").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
        F.lit(None).cast("timestamp").alias("ts"), F.lit("event").alias("kind"),
        F.replace("f", F.lit("#"), number).alias("fields"), F.replace("r", F.lit("#"), number).alias("raw"),
    )
    return rules.event_rule_hits(events).select("line_no", "rule_id", "severity", "matched_field", "matched_value")
