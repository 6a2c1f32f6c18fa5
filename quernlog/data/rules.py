"""Signature rules.  Fixed values: ids, severities, fields and needles are matched as written.

A key is a field name with an optional suffix ``_contains`` (default for event rules), ``_prefix``,
``_eq`` (default for entity rules) or ``_endswith``.  Values of one field are alternatives, different
fields must all hold.  Comparison ignores case.
"""

ARCHIVERS = ["7Z.EXE", "7ZG.EXE", "7ZFM.EXE", "RAR.EXE", "WINRAR.EXE", "BANDIZIP.EXE", "HAOZIP.EXE", "360ZIP.EXE", "KUAIZIP.EXE"]
MINER_PORTS = ["3333", "4444", "5555", "7777", "8333", "14444"]
STRATUM = ["stratum+tcp", "stratum+ssl", "stratum://"]
SHADOW_COMMANDS = ["delete shadows", "shadowcopy delete", "delete catalog", "recoveryenabled no"]
UNIX_SCRATCH = ["/tmp/", "/dev/shm", "/var/tmp/"]
SSHD_UNITS = ["sshd", "sshd-session"]


def _rule(rule_id: str, severity: str, title: str, match: dict, *, target: str = "event", min_hosts: int = 0) -> dict:
    return {
        "id": rule_id, "severity": severity, "title": title, "match": match, "target": target,
        "min_hosts": min_hosts, "max_hits": 500,
    }


def _ps(*commands: str) -> dict:
    return {"source_eq": ["ps_auxwwf"], "command_contains": list(commands)}


WEB_RULES = [
    _rule("abnormal-method", "info", "Unusual HTTP method", {"method": ["TRACE", "TRACK", "PUT", "DELETE"]}),
    _rule("cmd-exec-params", "high", "Command execution in the query string", {"query": [
        "cmd=", "exec=", ";id", ";cat%20", "|id", "eval(", "assert(", "system(", "passthru(", "shell_exec(",
        "/bin/sh", "/bin/bash", "whoami"]}),
    _rule("path-traversal", "high", "Path traversal", {"raw": [
        "../", "..%2f", "..\\", "/etc/passwd", "/etc/shadow", "boot.ini", "win.ini"]}),
    _rule("scanner-ua", "medium", "Scanner user agent", {"ua": [
        "sqlmap", "nikto", "acunetix", "netsparker", "w3af", "nmap", "masscan", "dirbuster", "gobuster", "hydra",
        "nuclei", "wpscan", "nessus", "openvas"]}),
    _rule("sensitive-path", "medium", "Request for a sensitive path", {"path": [
        "/.git/", "/.env", "/.svn/", "/.hg/", "/wp-admin", "/wp-login", "/phpmyadmin", "/backup.", "/config.php~",
        "/web.config"]}),
    _rule("sqli-time-based", "high", "Time-based SQL injection", {"query": [
        "sleep(", "benchmark(", "waitfor delay", "waitfor%20delay", "pg_sleep"]}),
    _rule("sqli-union-select", "high", "UNION-based SQL injection", {"query": [
        "union select", "union%20select", "union+select", "union all select", "or 1=1", "or%201=1",
        "information_schema"]}),
    _rule("waf-checker-ua", "info", "Site checker user agent", {"ua": ["QIANXIN CHECKER"]}),
    _rule("webshell-filename", "high", "Well-known web shell name", {"path": [
        "c99.php", "r57.php", "shell.php", "shell.jsp", "shell.asp", "cmd.jsp", "cmd.php", "webshell", "wso.php",
        "b374k", "chopper", "mini.php"]}),
    _rule("xss-javascript-protocol", "medium", "javascript: in the query string", {"query": ["javascript:", "javascript%3a"]}),
    _rule("xss-script-handler", "high", "Script or event handler in the query string", {"query": [
        "<script", "%3cscript", "onerror=", "onload=", "onclick=", "onfocus=", "onmouseover=", "onsubmit=", "alert("]}),
]

WINDOWS_RULES = [
    _rule("account-mgmt-system-subject", "medium", "Account change by SYSTEM or a machine account", {
        "channel_eq": ["Security"], "event_id_eq": ["4720", "4724", "4725", "4726", "4732", "4738"],
        "data_contains": ['"subjectusersid":"s-1-5-18"', '$"']}),
    _rule("browser-extension-forcelist", "medium", "Browser extension forced by policy", {"key_path_contains": ["extensioninstallforcelist"]}),
    _rule("lateral-admin-port-connection", "medium", "Connection on an administration port", {
        "local_port_eq": ["445", "3389", "5985", "5986"], "state_eq": ["established"]}),
    _rule("lateral-recon-cmdline", "low", "Network discovery command", {"command_contains": [
        "net use", "net view", "net share", "qwinsta", "query user"]}),
    _rule("lateral-remote-exec-tool-prefetch", "medium", "Remote execution tool was run", {"exe_name_eq": [
        "PSEXEC.EXE", "PSEXESVC.EXE", "PAEXEC.EXE", "CSEXEC.EXE", "WINRS.EXE", "AT.EXE"]}),
    _rule("lateral-remote-task-created", "medium", "Scheduled task created", {"channel_eq": ["Security"], "event_id_eq": ["4698"]}),
    _rule("lateral-service-installed", "medium", "Service installed", {"channel_eq": ["System"], "event_id_eq": ["7045"]}),
    _rule("lateral-service-writable-dir", "high", "Service image in a writable directory", {
        "channel_eq": ["System"], "event_id_eq": ["7045"],
        "data_contains": ["\\appdata\\", "\\temp\\", "\\programdata\\", "\\public\\"]}),
    _rule("ransom-security-log-cleared", "high", "Security log cleared", {"channel_eq": ["Security"], "event_id_eq": ["1102"]}),
    _rule("ransom-shadow-delete-cmdline", "high", "Shadow copies deleted by a process", {
        "channel_eq": ["Security"], "event_id_eq": ["4688"], "data_contains": SHADOW_COMMANDS}),
    _rule("ransom-shadow-delete-pshistory", "high", "Shadow copies deleted in shell history", {"command_contains": SHADOW_COMMANDS}),
    _rule("ransom-shadow-tool-prefetch", "medium", "Shadow copy tool was run", {"exe_name_eq": ["VSSADMIN.EXE", "WBADMIN.EXE", "BCDEDIT.EXE"]}),
    _rule("suspicious-run-key-non-system-dir", "medium", "Run key points outside system directories", {
        "key_path_contains": ["\\currentversion\\run"],
        "data_contains": ["\\appdata\\", "\\temp\\", "\\tmp\\", "\\programdata\\", "\\public\\", "\\users\\"]}),
]

EXFIL_RULES = [
    _rule("exfil-archive-create-cmdline", "medium", "Archive created on the command line", {"command_contains": [
        "7z a", "7za a", "rar a", "winrar a", "bandizip c"]}),
    _rule("exfil-compression-tool-prefetch", "low", "Archiver was run", {"exe_name_eq": ARCHIVERS}),
    _rule("exfil-encrypted-archive-cmdline", "high", "Encrypted archive created", {"command_contains": [
        "7z a -p", "7za a -p", "rar a -p", "rar a -hp", "winrar a -p"]}),
    _rule("exfil-transfer-port-outbound", "low", "Outbound transfer port", {
        "remote_port_eq": ["20", "21", "69", "873", "989", "990"], "state_eq": ["established"]}),
    _rule("exfil-upload-tool-cmdline", "medium", "Upload tool on the command line", {"command_contains": [
        "rclone copy", "rclone move", "rclone sync", "curl -t", "curl --upload-file", "pscp", "winscp.com", "ftp -s:"]}),
]

MINER_RULES = [
    _rule("miner-known-tool-prefetch", "high", "Known miner was run", {"exe_name_eq": [
        "xmrig.exe", "minerd.exe", "cpuminer.exe", "cpuminer-multi.exe", "ethminer.exe", "cgminer.exe",
        "bfgminer.exe", "nbminer.exe", "lolminer.exe"]}),
    _rule("miner-pool-port-outbound", "high", "Outbound mining pool port", {"remote_port_eq": MINER_PORTS, "state_eq": ["established"]}),
    _rule("miner-service-writable-dir", "medium", "Service image value in a writable directory", {
        "key_path_contains": ["\\services\\"], "value_name_eq": ["ImagePath"],
        "data_contains": ["\\appdata\\", "\\temp\\", "\\tmp\\", "\\programdata\\", "\\public\\"]}),
    _rule("miner-stratum-url-cmdline", "high", "Mining protocol URL", {"command_contains": STRATUM}),
    _rule("miner-tool-flags-cmdline", "medium", "Miner options", {"command_contains": ["--donate-level", "--coin", "--algo rx/", "--randomx"]}),
]

LINUX_RULES = [
    _rule("linux-conntrack-unreplied-out", "low", "Unanswered outbound connection", {"state_eq": ["SYN_SENT"], "flags_contains": ["UNREPLIED"]}),
    _rule("linux-cron-suspicious-exec", "medium", "Suspicious cron command", {
        "source_eq": ["crontab_all_users", "cron_sys", "anacrontab", "cron_spool"],
        "command_contains": ["/tmp/", "/dev/shm", "/var/tmp/", "curl ", "wget ", "base64"]}),
    _rule("linux-ebury-libns2", "high", "Backdoor library name", {"source_eq": ["ebury_ioc_libs"], "path_contains": ["libns2"]}),
    _rule("linux-ebury-sshd-lib", "high", "Backdoor library linked by sshd", {"source_eq": ["ldd_sshd"], "is_ioc_eq": ["true"]}),
    _rule("linux-empty-password-account", "high", "Account without password", {"source_eq": ["passwd"], "empty_password_eq": ["true"]}),
    _rule("linux-exfil-archive-cmdline", "low", "Archive created by a running process", _ps("tar cz", "tar -cz", "zip -r", "7z a", "rar a")),
    _rule("linux-exfil-copy-cmdline", "low", "Remote copy by a running process", _ps("scp ", "rsync ")),
    _rule("linux-exfil-shmtmp-archive", "medium", "Archive in a scratch directory", {
        "source_eq": ["shm_tmp_listing"], "name_endswith": [".tar.gz", ".tgz", ".zip", ".7z", ".rar", ".tar.bz2"]}),
    _rule("linux-exfil-upload-cmdline", "medium", "Upload by a running process", _ps("curl -t ", "curl --upload-file", "wget --post", "rclone", "lftp")),
    _rule("linux-lateral-internal-ssh-conn", "low", "Internal ssh connection", {
        "remote_port_eq": ["22"], "state_eq": ["established"], "remote_addr_prefix": ["10.", "192.168."]}),
    _rule("linux-lateral-root-accepted-authlog", "high", "root logon in the auth log", {
        "source_eq": ["auth_log"], "action_eq": ["accepted"], "user_eq": ["root"], "src_ip_contains": ["."]}),
    _rule("linux-lateral-root-accepted-journal", "high", "root logon in the journal", {
        "unit_eq": SSHD_UNITS, "action_eq": ["accepted"], "user_eq": ["root"], "src_ip_contains": ["."]}),
    _rule("linux-lateral-tunnel-tool-cmdline", "medium", "Tunnel tool is running", _ps("autossh", "frpc", "frps", "chisel", "socat", "ssh -d ")),
    _rule("linux-ld-preload-export", "high", "Preload variable exported", {"exports_contains": ["LD_PRELOAD"]}),
    _rule("linux-memfd-recovered-binary", "high", "Binary recovered from memory", {"source_eq": ["recovered_binaries"], "kind_eq": ["memfd"]}),
    _rule("linux-miner-known-tool-cmdline", "high", "Known miner is running", _ps("xmrig", "minerd", "cpuminer", "cgminer", "ethminer")),
    _rule("linux-miner-pool-port-conntrack", "medium", "Mining pool port tracked", {"dport_eq": MINER_PORTS}),
    _rule("linux-miner-proc-exe-writable", "high", "Executable in a scratch directory", {
        "source_eq": ["proc_cmdline_comm_exe_compare"], "exe_contains": UNIX_SCRATCH}),
    _rule("linux-miner-stratum-cmdline", "high", "Mining protocol URL in a running process", _ps(*STRATUM)),
    _rule("linux-pam-exec-hook", "medium", "Authentication hook runs a program", {"is_pam_exec_eq": ["true"]}),
    _rule("linux-ransom-deleted-held-file", "low", "Deleted file held open", {
        "source_eq": ["lsof_deleted_open"], "type_eq": ["REG"], "nlink_eq": ["0"], "name_prefix": ["/"]}),
    _rule("linux-ransom-destructive-cmdline", "high", "Destructive command is running", _ps(
        "lvremove", "vgremove", "wipefs", "shred ", "mkfs.", "cryptsetup", "dd if=/dev/zero", "rm -rf /")),
    _rule("linux-ransom-note-shmtmp", "high", "Ransom note name", {"source_eq": ["shm_tmp_listing"], "name_contains": [
        "how_to_decrypt", "readme_for_decrypt", "recover_files", "decrypt_instruction", "restore_files", "how_to_recover"]}),
    _rule("linux-ssh-suspicious-authkey", "high", "Suspicious authorized key", {"risk_flags_contains": [
        "weak_key", "forced_command", "placeholder_comment", "unattributable_comment"]}),
    _rule("linux-sshd-accepted-authlog", "high", "ssh logon in the auth log", {
        "source_eq": ["auth_log"], "action_eq": ["accepted"], "src_ip_contains": ["."]}),
    _rule("linux-sshd-accepted-journal", "high", "ssh logon in the journal", {
        "unit_eq": SSHD_UNITS, "action_eq": ["accepted"], "src_ip_contains": ["."]}),
    _rule("linux-systemd-suspicious-path", "high", "Unit starts a program in a scratch directory", {"exec_start_contains": UNIX_SCRATCH}),
    _rule("linux-udev-exec-shm", "high", "Device rule runs a program in shared memory", {"has_exec_eq": ["true"], "raw_contains": ["/dev/shm"]}),
    _rule("linux-uid0-account", "medium", "Account with uid 0", {"source_eq": ["passwd"], "uid_eq": ["0"]}),
]

ENTITY_RULES = [
    _rule("exfil-cloud-storage-domain", "medium", "Cloud storage domain", {"entity_type": ["domain"], "raw_value_contains": [
        "pan.baidu", "baidupcs", "weiyun", "aliyundrive", "quark.cn", "123pan", "cowtransfer", "wetransfer",
        "mega.nz", "dropbox", "terabox", "gofile.io", "transfer.sh", "file.io", "pixeldrain"]}, target="entity"),
    _rule("miner-pool-domain-entity", "medium", "Mining pool domain", {"entity_type": ["domain"], "raw_value_contains": [
        "pool.", "stratum", "minexmr", "nanopool", "f2pool", "antpool", "supportxmr", "hashvault", "minergate"]}, target="entity"),
    _rule("xhost-shared-account-sid", "medium", "Account SID on several hosts", {
        "entity_type": ["account"], "qualifier": ["global"]}, target="entity", min_hosts=2),
    _rule("xhost-shared-file-hash", "high", "File hash on several hosts", {
        "entity_type": ["file_hash"], "qualifier": ["global"]}, target="entity", min_hosts=2),
    _rule("xhost-shared-public-ip", "medium", "Public address on several hosts", {
        "entity_type": ["ip"], "qualifier": ["global"]}, target="entity", min_hosts=2),
]

EVENT_RULES = WEB_RULES + WINDOWS_RULES + EXFIL_RULES + MINER_RULES + LINUX_RULES
ALL_RULES = EVENT_RULES + ENTITY_RULES
