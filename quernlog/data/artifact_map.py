"""Where the files of a collection package belong.  Fixed values, first match wins.

``(glob, artifact, route, parser or descriptor, log type)``; a glob with '/' is matched against the path
inside the package, any other one against the file name only.
"""

PACKAGE_ROOT = r"^(Forensic|LinuxSC)_[^_/]+_[^/]+$"
PACKAGE_HOST = r"^(?:Forensic|LinuxSC)_([^_/]+)_[^/]+$"


def _native(artifact: str, parser: str, globs: list[str], log_type: str = "") -> list[tuple[str, ...]]:
    return [(g, artifact, "native", parser, log_type) for g in globs]


def _raw(artifact: str, globs: list[str]) -> list[tuple[str, ...]]:
    return [(g, artifact, "raw", "", "") for g in globs]


_UNITS = ["service", "timer", "socket", "target", "mount", "path", "automount", "slice", "scope"]
_DROPINS = ["etc/systemd/system", "usr/lib/systemd/system", "lib/systemd/system", "run/systemd/system", "etc/systemd/user"]
_SHELL_GLOBAL = ["profile", "profile.d/*", "bashrc", "bash.bashrc", "zshrc", "zsh/*"]
_SHELL_USER = [".bashrc", ".bash_profile", ".bash_login", ".profile", ".bash_logout", ".zshrc"]

RULES: list[tuple[str, ...]] = [
    ("Windows_logs/*.evtx", "windows_event_log", "evtx_native", "", ""),
    *_native("usn_journal", "usn_csv", ["usn_journal_*.csv"], "usn_journal"),
    *_native("mft", "mft", ["MFT.bin"]),
    *_native("prefetch", "prefetch", ["Prefetch/*.pf"]),
    *_native("registry_hive", "sam_accounts", ["SAM"]),
    *_native("registry_hive", "security_policy", ["SECURITY"]),
    *_native("registry_hive", "registry_hive", ["SOFTWARE"]),
    *_native("registry_hive", "system_hive", ["SYSTEM"]),
    *_native("registry_hive", "registry_hive", ["DEFAULT", "NTUSER.DAT", "NTUSER.dat", "UsrClass.dat"]),
    *_native("lnk", "lnk", ["*.lnk"]),
    *_native("everything_efu", "efu", ["*.efu"]),
    *_native("jumplist", "jumplist", ["*.automaticDestinations-ms", "*.customDestinations-ms"]),
    *_native("browser_history", "browser_chromium_history", ["History"]),
    *_native("browser_history", "browser_firefox_places", ["places.sqlite"]),
    *_native("srum", "srum", ["SRUDB.dat"]),
    *_native("activitiescache", "win_activities", ["ActivitiesCache.db"]),
    *_raw("hash_manifest", ["_HASH_MANIFEST.txt"]),
    *_raw("collection_meta", ["_COLLECTION_TIME.txt"]),
    *_raw("collection_errors", ["_COLLECT_ERRORS.log"]),
    ("PSHistory/ConsoleHost_history.txt", "command_history", "desc", "pshistory", ""),
    *_native("net_connection", "netstat", ["netstat.txt", "netstat_established.txt"], "net_connection"),
    *_raw("registry_query", ["REG_*.txt"]),
    *_raw("wmic_snapshot", ["WMIC_*"]),
    *_native("auth_log", "linux_authlog", ["Logs/var/log/auth.log", "Logs/var/log/secure"], "audit_log"),
    *_native("syslog", "linux_syslog", ["Logs/var/log/messages", "Logs/var/log/syslog", "Logs/var/log/cron"], "app_log"),
    *_native("pkg_log", "linux_yumlog", ["Logs/var/log/yum.log"], "audit_log"),
    ("Logs/var/log/dpkg.log", "pkg_log", "desc", "linux-dpkg", ""),
    ("Logs/var/log/dpkg.log.1", "pkg_log", "desc", "linux-dpkg", ""),
    *_native("journal_export", "linux_journal_full", ["Logs/journalctl_full_shortiso.txt"], "app_log"),
    *_native("journal_export", "linux_journal_short", ["Logs/journalctl_sshd_unit.txt", "Logs/journalctl_xe.txt"], "app_log"),
    *_native("login_history", "linux_last", ["Logs/last.txt", "Logs/lastb.txt"], "audit_log"),
    *_native("login_history", "linux_lastlog", ["Logs/lastlog.txt"], "audit_log"),
    *_native("net_connection", "linux_ss", ["Network/ss_tuanp.txt"], "net_connection"),
    *_native("net_connection", "linux_netstat", ["Network/netstat_tuanp.txt"], "net_connection"),
    *_native("conntrack", "linux_conntrack", ["Network/conntrack_L.txt"]),
    *_native("local_account", "linux_passwd", ["SystemInfo/etc/passwd"]),
    *_native("local_group", "linux_group", ["SystemInfo/etc/group"]),
    *_native("scheduled_task", "linux_cron_all", ["Persistence/crontab_all_users.txt"]),
    *_native("scheduled_task", "linux_cron_sys", ["Persistence/etc/crontab", "Persistence/etc/cron.d/*"]),
    *_native("scheduled_task", "linux_anacrontab", ["Persistence/etc/anacrontab"]),
    *_native("scheduled_task", "linux_cron_spool", ["Persistence/var/spool/cron/crontabs/*", "Persistence/var/spool/cron/*"]),
    *_native("systemd_unit", "linux_systemd", [f"*.{u}" for u in _UNITS]),
    *_native("systemd_unit", "linux_systemd_dropin", [f"Persistence/{d}/*.d/*.conf" for d in _DROPINS]),
    *_native("udev_rule", "linux_udev", ["*.rules"]),
    *_native("pam_rule", "linux_pam", ["Persistence/etc/pam.d/*"]),
    *_native("shell_config", "linux_shellcfg", [f"Persistence/etc/{f}" for f in _SHELL_GLOBAL]),
    *_native("shell_config", "linux_shellcfg", [f"Persistence/root/{f}" for f in _SHELL_USER]),
    *_native("shell_config", "linux_shellcfg", [f"Persistence/home/*/{f}" for f in _SHELL_USER]),
    *_native("ssh_key", "linux_authkeys", [
        "SSH/root/.ssh/authorized_keys", "SSH/root/.ssh/authorized_keys2",
        "SSH/home/*/.ssh/authorized_keys", "SSH/home/*/.ssh/authorized_keys2"]),
    *_native("sshd_config", "linux_sshd_config", ["SSH/etc/ssh/sshd_config"]),
    *_native("sshd_config", "linux_sshd_effective", ["SSH/sshd_T_effective_config.txt"]),
    *_native("sshd_lib_deps", "linux_sshd_libs", ["SSH/ldd_sshd.txt"]),
    *_native("ssh_dir_perm", "linux_ssh_dir_perms", ["SSH/user_ssh_dir_permissions.txt"]),
    *_native("ebury_ioc", "linux_ebury_ioc", ["RootkitHunt/ebury_ioc_libs.txt"]),
    *_native("recovered_binary", "linux_recovered_nohits", ["RecoveredBinaries/_no_hits.txt"]),
    *_native("recovered_binary", "linux_recovered", ["RecoveredBinaries/*.bin"]),
    *_native("process_snapshot", "linux_ps", ["ProcInfo/ps_auxwwf.txt"]),
    *_native("proc_identity", "linux_proc_identity", ["ProcInfo/proc_cmdline_comm_exe_compare.txt"]),
    *_native("shm_tmp_listing", "linux_shmtmp", ["ProcInfo/shm_tmp_listing.txt"]),
    *_native("deleted_file_suspect", "linux_lsof_deleted", ["ProcInfo/lsof_deleted_open.txt"]),
    *_native("deleted_file_suspect", "linux_proc_exe_deleted", ["ProcInfo/proc_exe_deleted.txt"]),
    *_native("deleted_file_suspect", "linux_proc_fd_memfd", ["ProcInfo/proc_fd_memfd.txt"]),
    *_native("deleted_file_suspect", "linux_proc_maps", ["ProcInfo/proc_maps_suspicious_exec.txt"]),
    *_raw("init_script", ["Persistence/etc/init.d/*", "Persistence/etc/rc.d/init.d/*"]),
    *_raw("rc_link", ["Persistence/etc/rc?.d/*", "Persistence/etc/rc.d/rc?.d/*"]),
    *_raw("xdg_autostart", ["Persistence/etc/xdg/autostart/*", "Persistence/home/*/.config/autostart/*"]),
    *_raw("periodic_script", [
        *[f"Persistence/etc/cron.{p}/*" for p in ("daily", "hourly", "weekly", "monthly")], "Persistence/etc/update-motd.d/*"]),
    *_raw("ldso_conf", ["Persistence/etc/ld.so.conf", "Persistence/etc/ld.so.conf.d/*"]),
    *_raw("kernel_module_conf", ["Persistence/etc/modprobe.d/*", "Persistence/etc/modules-load.d/*", "Persistence/etc/modules"]),
    *_raw("resolver", ["Network/etc/resolv.conf"]),
    *_raw("rc_local", ["Persistence/etc/rc.local", "Persistence/etc/rc.d/rc.local"]),
    *_raw("anacron_spool", ["Persistence/var/spool/anacron/*"]),
    *_raw("at_spool", ["Persistence/var/spool/at/*"]),
    *_raw("collection_meta", ["_COLLECT_FOOTPRINT.txt", "_SYMLINKS.txt"]),
    *_raw("linux_log_file", ["Logs/var/log/*", "Logs/var/log/*/*", "Logs/var/log/*/*/*"]),
    *_raw("csv_snapshot", ["*.csv"]),
    *_raw("html_snapshot", ["*.html"]),
    *_raw("text_snapshot", ["*.txt"]),
    *_raw("log_snapshot", ["*.log"]),
    *_raw("registry_export", ["*.reg"]),
    *_raw("binary_artifact", ["*.bin", "*.dat"]),
]
