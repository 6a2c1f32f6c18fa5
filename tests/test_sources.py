import json
import os

from pyspark.sql import functions as F

from quernlog.data.descriptors import LINUX_DPKG, PSHISTORY, RAW_TEXT, TOMCAT_CATALINA
from quernlog.sources import access_log, descriptors, file_lists, linux_logs, packages, snapshots
from quernlog.sources.lines import read_lines, sniff_text, split_lines
from quernlog.sources.records import canonical_records, to_events


def got(df):
    rows = df.withColumn("norm", F.to_json("norm")).orderBy("line_no").collect()
    return [(r.line_no, r.kind, str(r.dt_local or r.ts_direct or ""), json.loads(r.norm) if r.norm else None) for r in rows]


def test_access_log(lines):
    rows = got(access_log.parse_access_log(lines([
        '203.0.113.9 - bob [10/Oct/2025:13:55:36 +0800] "GET /a?x=1?2 HTTP/1.1" 200 12 "-" "UA 1" "8.8.8.8, 1.1.1.1"',
        "", '203.0.113.9 - - [10/Oct/2025:13:55:36 +0800] "-" 400 - "-" "-"', "garbage",
        '203.0.113.9 - - [99/Oct/2025:13:55:36 +0800] "GET / HTTP/1.0" 400 0 "r" "u"',
    ])))
    assert [r[1] for r in rows] == ["event", "skip", "event", "bad", "bad"]
    first = rows[0][3]
    assert (first["path"], first["query"], first["status"], first["xff"]) == ("/a", "x=1?2", 200, "8.8.8.8, 1.1.1.1")
    assert "referer" not in first and first["extras"] == {"time_offset": "+0800", "protocol": "HTTP/1.1"}
    assert rows[2][3]["extras"]["request"] == "-" and "bytes" not in rows[2][3]


def test_multiline_blocks(lines):
    rows = descriptors.parse_lines(lines([
        "orphan", "10-01 10:00:00 INFO a.B - start", "  at x", "", "  at y", "10-01 10:00:01 WARN [t1] c.D msg",
    ]), TOMCAT_CATALINA).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.continuation_lines) for r in rows] == [
        (1, "bad", 0), (2, "event", 2), (4, "skip", 0), (6, "event", 0)]
    assert rows[1].raw.endswith("at x\n  at y") and str(rows[1].dt_local) == "1900-10-01 10:00:00"


def test_multiline_caps(lines):
    by_count = descriptors.parse_lines(lines(
        ["10-01 10:00:00 INFO a.B - start", "x1", "x2", "x3", "x4", "x5"]),
        {**TOMCAT_CATALINA, "max_continuation_lines": 2}).orderBy("line_no").collect()
    assert [(r.line_no, r.kind) for r in by_count] == [(1, "event"), (4, "bad")]
    head = "10-01 10:00:00 INFO a.B - st"
    texts = [head, "x" * 30, "y" * 30, "z" * 30, "w" * 5, "v" * 80, "u"]
    by_size = descriptors.parse_lines(
        lines(texts), {**TOMCAT_CATALINA, "max_continuation_lines": 3, "max_block_bytes": 70}).orderBy("line_no").collect()
    # greedy reference
    want, start, size, count = [1], 0, len(texts[0]), 0
    for i, t in enumerate(texts[1:], 1):
        if count >= 3 or size + len(t) > 70:
            want.append(i + 1)
            start, size, count = i, len(t), 0
        else:
            size, count = size + len(t), count + 1
    assert [r.line_no for r in by_size] == want


def test_blocks_are_whole_without_named_caps(lines):
    plain = {k: v for k, v in TOMCAT_CATALINA.items() if not k.startswith("max_")}
    texts = ["01-Oct-2025 10:00:00.000 INFO a.B - start", *(f"  at line {k} " + "x" * 600 for k in range(2500)), "01-Oct-2025 10:00:01.000 INFO a.B - end"]
    rows = descriptors.parse_lines(lines(texts), plain).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.continuation_lines) for r in rows] == [(1, "event", 2500), (2502, "event", 0)]
    assert len(rows[0].raw) > 1_500_000
    cut = descriptors.parse_lines(lines(texts), {**plain, "max_block_bytes": 1_000_000}).collect()
    assert len(cut) == 3 and max(len(r.raw) for r in cut) <= 1_010_000


def test_json_csv_and_text_descriptors(lines):
    js = {"kind": "json", "field_map": {"t": "ts_raw", "lvl": "level"}, "ts_field": "t", "ts_formats": ["%Y-%m-%d %H:%M:%S"]}
    rows = got(descriptors.parse_lines(lines(
        ['{"t":"2025-01-02 03:04:05","lvl":"E","n":1,"o":{"a":[1]}}', '{"t":"x"}', "nope", "[1]", '{"a":1} {"b":2}', " "]), js))
    assert [r[1] for r in rows] == ["event", "bad", "bad", "bad", "bad", "skip"]
    assert rows[0][3] == {"level": "E", "extras": {"n": 1, "o": {"a": [1]}}}
    cs = {**js, "kind": "csv"}
    rows = got(descriptors.parse_lines(lines(["", "t,lvl,msg", '2025-01-02 03:04:05,E,"a,""b"""', "short,1"]), cs))
    assert [r[1] for r in rows] == ["skip", "skip", "event", "bad"]
    assert rows[2][3] == {"level": "E", "extras": {"msg": 'a,"b"'}}
    assert got(descriptors.parse_lines(lines(["  dir c:  "]), PSHISTORY))[0][3] == {"command": "dir c:", "cmdline": "dir c:"}
    assert got(descriptors.parse_lines(lines(["2025-01-02 03:04:05 startup"]), LINUX_DPKG))[0][3] == {"action": "startup"}
    assert got(descriptors.parse_lines(lines(["any text"]), RAW_TEXT))[0][3] == {"message": "any text"}


def test_syslog_years_and_actions(lines):
    rows = got(linux_logs.parse_syslog(lines([
        "Dec 31 23:59:59 web1 sshd[12]: Accepted password for root from 203.0.113.5 port 22",
        "Jan  2 00:00:01 web1 sshd: Failed password for invalid user bob from 203.0.113.6",
        "2026-01-01T02:04:51.5+00:00 web1 sudo[1]: x pam_unix(sudo:session): session opened for user root",
        "Xyz 12 00:00:00 h t: m", "noise",
    ]), "auth_log", "2026-01-03", auth=True))
    assert [r[1] for r in rows] == ["event", "event", "event", "skip", "skip"]
    assert rows[0][2] == "2025-12-31 23:59:59" and rows[0][3]["year_rollover"] is True
    assert rows[0][3]["action"] == "accepted" and rows[0][3]["src_ip"] == "203.0.113.5" and rows[0][3]["pid"] == "12"
    assert rows[1][2] == "2026-01-02 00:00:01" and rows[1][3]["action"] == "failed" and rows[1][3]["user"] == "bob"
    assert rows[2][2] == "2026-01-01 02:04:51.500000" and "action" not in rows[2][3]  # anchored session pattern
    loose = got(linux_logs.parse_syslog(lines(["Xyz 12 00:00:00 h t[1]: pam_unix(x:s): session closed for user u"]), "messages"))
    assert loose[0][1] == "event" and loose[0][3]["month_unrecognized"] == "true" and loose[0][3]["unit"] == "t"


def test_journal_and_login_records(lines):
    iso = got(linux_logs.parse_journal_iso(lines(["-- note", "2026-07-28T17:06:30+0800 h sshd[7]: Invalid user x from 203.0.113.7"])))
    assert iso[0][1] == "skip" and iso[1][2] == "2026-07-28 09:06:30" and iso[1][3]["action"] == "invalid_user"
    short = got(linux_logs.parse_journal_short(lines(["7月 28 17:17:44 h u: m", "Mar 12 16:46:24 h u[3]: m"]), collected="2026-07-28"))
    assert [r[2] for r in short] == ["2026-07-28 17:17:44", "2026-03-12 16:46:24"]
    last = got(linux_logs.parse_last(lines([
        "root pts/0 203.0.113.8 Mon Jul 27 10:00:00 2026 - Mon Jul 27 11:00:00 2026 (01:00)", "wtmp begins Mon Jul 1"])))
    assert last[0][3]["end"] == "2026-07-27 11:00:00" and last[0][3]["status"] == "(01:00)" and last[1][1] == "skip"
    log = got(linux_logs.parse_lastlog(lines([
        "Username Port From Latest", "bob                **Never logged in**",
        "root pts/0 203.0.113.8 Mon Jul 27 10:00:00 +0800 2026", "amy Mon 7月 27 10:00:00 +0800 2026"])))
    assert [r[1] for r in log] == ["skip", "event", "event", "event"]
    assert log[1][3]["never"] == "true" and log[2][2] == "2026-07-27 02:00:00" and "port" not in log[3][3]
    yum = got(linux_logs.parse_yum(lines(["Mar 12 16:46:24 Installed: a-1", "Zzz 1 00:00:00 x"]), "2026-04-01"))
    assert yum[0][2] == "2026-03-12 16:46:24" and yum[1][1] == "skip"


def test_socket_tables(lines):
    ss = got(snapshots.parse_ss(lines([
        "Netid State Recv-Q Send-Q Local Peer", 'tcp ESTAB 0 0 10.0.0.1%eth0:22 [::ffff:203.0.113.1]:5000 users:(("sshd",pid=9,fd=3))',
        "udp UNCONN 0 0 fe80::1 *:*"])))
    assert ss[1][3]["local_addr"] == "10.0.0.1" and ss[1][3]["remote_port"] == "5000" and ss[1][3]["process_name"] == "sshd"
    assert ss[2][3]["local_addr"] == "fe80::1" and "local_port" not in ss[2][3] and ss[2][3]["remote_addr"] == "*"
    ns = got(snapshots.parse_netstat(lines(["Proto x", "tcp 0 0 0.0.0.0:22 0.0.0.0:* LISTEN 1/sshd", "udp 0 0 0.0.0.0:68 0.0.0.0:* 7/dh/x"])))
    assert ns[1][3]["state"] == "LISTEN" and ns[1][3]["pid"] == "1" and ns[2][3]["process_name"] == "dh/x"
    win = got(snapshots.parse_windows_netstat(lines([
        "Active Connections", "  TCP    10.0.0.1:445   203.0.113.1:50  ESTABLISHED  4", "  RpcSs", " [svchost.exe]",
        "  UDP    [::]:123   *:*   900", " Can not obtain ownership information"]), chunk=2))
    assert win[1][3]["process_name"] == "svchost.exe" and win[1][3]["service"] == "RpcSs"
    assert win[4][3]["local_addr"] == "::" and win[4][3]["pid"] == "900" and "process_name" not in win[4][3]


def test_conntrack(lines):
    rows = lines(["tcp 6 100 ESTABLISHED src=1.1.1.1 dst=2.2.2.2 sport=1 dport=3333 src=2.2.2.2 dst=1.1.1.1 [ASSURED] mark=0",
                  "icmp 1 29 src=1.1.1.1 dst=2.2.2.2 [UNREPLIED]", "bad line", "", "tcp 6 1 SYN_SENT src=3.3.3.3"])
    out = got(snapshots.parse_conntrack(rows, cap=3))
    assert out[0][3]["remote_addr"] == "2.2.2.2" and out[0][3]["flags"] == "ASSURED" and "state" not in out[1][3]
    assert [r[1] for r in out] == ["event", "event", "skip", "skip", "skip"]
    s = snapshots.conntrack_summary(rows, cap=3).collect()[0]
    assert (s.total_lines, s.malformed_lines, s.emitted_entries, s.truncated_entries, s.capped) == (4, 1, 2, 0, "false")


def test_process_account_schedule_tables(lines):
    ps = got(snapshots.parse_ps(lines(["USER PID", "root 1 0.0 0.1 10 20 ? Ss 6月30 0:01 /sbin/init  splash"])))
    assert ps[1][3]["command"] == "/sbin/init  splash" and ps[1][3]["account"] == "root"
    ident = got(snapshots.parse_process_identity(lines(["PID\tCOMM\tCMD\tEXE", "1\tsh\t-\t/usr/bin/dash", "2\tkworker\t\t"])))
    assert ident[1][3]["comm_exe_mismatch"] == "true" and ident[2][3]["exe_missing"] == "true"
    pw = got(snapshots.parse_passwd(lines(["root::0:0:r:/root:/bin/sh", "# c", "x:y"])))
    assert pw[0][3]["empty_password"] == "true" and [r[1] for r in pw] == ["event", "skip", "skip"]
    assert got(snapshots.parse_group(lines(["wheel:x:10:a,,b"])))[0][3]["members"] == ["a", "b"]
    cron = got(snapshots.parse_crontab_sections(lines([
        "* * * * * early", "===== bob =====", "MAILTO=x", "*/5 * * * * curl x", "no crontab for bob", "===== amy =====", "@reboot run me"]), chunk=2))
    assert [(r[1], (r[3] or {}).get("user")) for r in cron] == [
        ("skip", None), ("skip", None), ("skip", None), ("event", "bob"), ("event", "bob"), ("skip", None), ("event", "amy")]
    assert got(snapshots.parse_system_cron(lines(["17 * * * * root cd / && run"], "/x/crontab")))[0][3]["file"] == "crontab"
    assert got(snapshots.parse_anacrontab(lines(["1 5 cron.daily nice run"])))[0][3]["job_id"] == "cron.daily"
    assert [r[1] for r in got(snapshots.parse_cron_spool(lines(["* * * * * x", "junk"])))] == ["event", "bad"]


def test_authorized_keys(lines):
    import base64
    import struct

    def field(b):
        return struct.pack(">I", len(b)) + b

    def rsa(bits):
        n = (1 << (bits - 1)).to_bytes(bits // 8, "big")
        return base64.b64encode(field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(b"\x00" + n)).decode()

    rows = got(snapshots.parse_authorized_keys(lines([
        f"ssh-rsa {rsa(1024)} bob@localhost", f'from="1.2.3.4",command="x y" ssh-rsa {rsa(2048)}', "ssh-ed25519 AAAA admin",
        "ecdsa-sha2-nistp384 AAAA a@b", "# no", "junk"], "/c/home/bob/.ssh/authorized_keys")))
    assert [r[1] for r in rows] == ["event"] * 4 + ["skip"] * 2
    assert (rows[0][3]["key_bits"], rows[0][3]["risk_flags"], rows[0][3]["owner"]) == (1024, "weak_key placeholder_comment", "bob")
    assert (rows[1][3]["key_bits"], rows[1][3]["risk_flags"]) == (2048, "forced_command no_comment")
    assert rows[2][3]["risk_flags"] == "unattributable_comment" and rows[3][3]["key_bits"] == 384


def test_usn_and_file_list(lines):
    row = "{},{},10,{},txt,2026/7/9 15:15:46,0x20,arch,0x1,0x2,0,0,1,2,0,80"
    recs = file_lists.parse_usn(lines([
        "ID : 0x1", "Usn,name,len,reason,text,time,a,b,c,d,e,f,g,h,i,j", row.format(100, "a.txt", "0x80000100"),
        row.format("x", "b.txt", "0x00000002"), row.format(120, "a.txt", "0x00000008")]))
    rows = got(recs)
    assert [r[1] for r in rows] == ["skip", "skip", "event", "bad", "event"]
    assert rows[2][3]["reason_flags"] == ["FILE_CREATE", "CLOSE"] and rows[4][3]["reason_flags"] == ["UNKNOWN_0x00000008"]
    s = file_lists.usn_summary(recs).collect()[0]
    assert (s.total_rows, s.valid_rows, s.bad_rows, s.first_usn, s.last_usn, s.file_creates) == (3, 2, 1, 100, 120, 1)
    assert file_lists.usn_top_files(recs).collect()[0]["count"] == 2
    efu = file_lists.parse_file_list(lines([
        "Filename,Size,Date Modified,Date Created,Attributes", '"C:\\a\\b.TXT",12,132539328000000000,0,32', "D:\\,x,,,", ",,,,"]))
    rows = got(efu)
    assert rows[1][3]["extension"] == "txt" and rows[1][2] == "2021-01-01 00:00:00" and rows[2][3]["filename"] == "D:\\"
    assert {(r.drive, r["count"]) for r in file_lists.file_list_drives(efu).collect()} == {("C", 1), ("D", 1)}


def test_numbered_lines_across_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.log").write_bytes("\r\n".join(texts).encode() + b"\r\n")
    (tmp_path / "b.log").write_bytes(b"one\rtwo \xff\xe2\x80A\n\nfour")
    (tmp_path / "g.txt").write_bytes("中文\n第二".encode("gbk"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {r.line_no: r.raw for r in rows if r.source_id.endswith("a.log")}
    assert a == {i + 1: t for i, t in enumerate(texts)}
    b = {r.line_no: r.raw for r in rows if r.source_id.endswith("b.log")}
    assert b == {1: "one", 2: "two \ufffd\ufffdA", 3: "", 4: "four"}
    assert [r.raw for r in read_lines(spark, str(tmp_path / "g.txt"), "gbk").orderBy("line_no").collect()] == ["中文", "第二"]
    docs = spark.createDataFrame([("d", "a\r\nb\rc\n")], "id string, text string")
    assert [r.raw for r in split_lines(docs, "id", "text").orderBy("line_no").collect()] == ["a", "b", "c"]


def test_sniff_route_manifest_fingerprint(spark, lines, tmp_path):
    data = [(bytearray(b"plain text\n"),), (bytearray(b"\xef\xbb\xbf\x00"),), (bytearray(b"a\x00b"),), (bytearray(b"\x01" * 5 + b"a" * 95),), (bytearray(b""),)]
    df = spark.createDataFrame(data, "c binary")
    assert [r[0] for r in df.select(sniff_text(F.col("c"))).collect()] == [True, True, False, False, True]
    files = spark.createDataFrame([("Logs/var/log/auth.log",), ("x/y/SAM",), ("a.weird",), ("Persistence/etc/cron.d/j",), ("Logs/var/log/x/y.txt",)], "rel_path string")
    routed = {r.rel_path: (r.artifact_type, r.route, r.parser) for r in packages.route_files(files).collect()}
    assert routed["Logs/var/log/auth.log"] == ("auth_log", "native", "linux_authlog")
    assert routed["x/y/SAM"][0] == "registry_hive" and routed["a.weird"] == ("unmapped", "raw", "")
    assert routed["Persistence/etc/cron.d/j"][2] == "linux_cron_sys" and routed["Logs/var/log/x/y.txt"][0] == "linux_log_file"
    root = tmp_path / "Forensic_1.2.3.4_pc"
    os.makedirs(root)
    (root / "a.txt").write_text("a")
    (root / "b.txt").write_text("b")
    (root / "c.txt").write_text("c")
    sums = packages.file_checksums(spark, str(root))
    sha = {r.rel_path: r.sha256 for r in sums.collect()}
    entries = packages.manifest_entries(lines([
        "Host=x", f"{sha['a.txt']}  C:\\t\\{root.name}\\a.txt", f"{'0' * 64}  C:\\t\\{root.name}\\b.txt",
        f"{'1' * 64}  C:\\t\\{root.name}\\gone.txt", "what is this", f"{'1' * 64}  C:\\elsewhere\\x"]), root.name)
    states = packages.reconcile(entries, sums)
    s = packages.reconcile_summary(states, entries).collect()[0]
    assert (s.ok, s.missing, s.mismatch, s.extra, s.bad_lines, s.passed) == (1, 1, 1, 1, 2, False)
    host = spark.createDataFrame([(root.name,), ("other",)], "n string").select(packages.package_host(F.col("n"))).collect()
    assert [r[0] for r in host] == ["1.2.3.4", None]
    cands = {"access": access_log.parse_access_log, "dpkg": lambda x: descriptors.parse_lines(x, LINUX_DPKG)}
    best = packages.fingerprint(lines(["2025-01-02 03:04:05 install a"] * 30 + ["junk"] * 4), cands).collect()[0]
    assert best.format_id == "dpkg" and abs(best.confidence - (40 + 10) / (40 + 14)) < 1e-9 and best.detect_status == "auto"


def test_zone_and_canonical_record(spark, lines):
    recs = descriptors.parse_lines(lines(["2025-01-02 03:04:05 install a"]), LINUX_DPKG)
    schema = "case_id string, source_id string, tz string, log_type string, artifact_type string, host string"

    def ts(tz):
        src = spark.createDataFrame([("c", "s", tz, "audit_log", "pkg_log", "h")], schema)
        return str(to_events(recs, src).collect()[0].ts), json.loads(canonical_records(recs, src).collect()[0].record).get("ts_utc") if tz else None

    assert ts("Asia/Shanghai") == ("2025-01-01 19:04:05", "2025-01-01T19:04:05Z")
    assert ts("UTC+8")[0] == ts("Asia/Beijing")[0] == ts("GMT+08:00")[0] == "2025-01-01 19:04:05"
    assert ts("nowhere")[0] == ts("")[0] == "None"


def test_whole_command_history(spark, tmp_path):
    """Texts that differ behind their 60th character differ, and every character counts."""
    import hashlib

    import __spark_entry__ as entry

    texts = {1: "x" * 60 + " one\ttab\nline ", 2: "x" * 60 + " two", 3: " \n\t", 4: None, 5: "long " * 40000 + "end", 6: " " * 70 + "late", 7: "a\u2028b\u0085c"}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.line_no: r.digest for r in entry.queries()["parse_command_history_whole"](spark, str(tmp_path)).collect()}
    flat = {i: t.translate({10: " ", 13: " ", 9: " "}).strip(" ") for i, t in texts.items() if t is not None}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in flat.items() if t}
