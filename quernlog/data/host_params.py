"""Default parameters of the host detectors.  Fixed values."""

BENIGN_TASK_NAMES = [r"(?i)(microsoft|windows|google|adobe|intel|nvidia)"]

SUSPICIOUS_EXEC = [
    r"(?i)\\(temp|tmp)\\",
    r"(?i)\\users\\public\\",
    r"(?i)\\appdata\\(local|roaming)\\temp\\",
    r"(?i)\b(powershell(\.exe)?|cmd\.exe|wscript\.exe|cscript\.exe|mshta\.exe|rundll32\.exe|regsvr32\.exe)\b",
]

WRITABLE_DIRS = [
    r"(?i)\\appdata\\",
    r"(?i)\\temp\\",
    r"(?i)\\tmp\\",
    r"(?i)\\programdata\\",
    r"(?i)\\users\\public\\",
    r"(?i)\\windows\\(temp|debug)\\",
    r"(?i)\b(powershell(\.exe)?|cmd\.exe|mshta\.exe|rundll32\.exe)\b.*-(e|en|enc)\b",
]

LOOKALIKE_TARGETS = [
    "svchost", "lsass", "csrss", "explorer", "rundll32", "services", "winlogon", "taskhost", "sihost",
    "runtimebroker",
]

SYSTEM_DIRS = [
    "c:\\windows\\system32\\",
    "c:\\windows\\syswow64\\",
    "c:\\windows\\winsxs\\",
    "c:\\windows\\servicing\\",
    "c:\\program files\\",
    "c:\\program files (x86)\\",
]

SAM_OBJECTS = [r"(?i)\\REGISTRY\\MACHINE\\(SAM|SECURITY)", r"(?i)HKLM\\(SAM|SECURITY)", r"(?i)\bSAM\.dll"]

SAM_PROCESS_ALLOWLIST = [
    r"(?i)\\(lsass|winlogon|csrss|smss|services|svchost)\.exe$",
    r"(?i)^(system|registry)$",
]

# overwrite 0x1, extend 0x2, truncate 0x4, create 0x100, delete 0x200, rename 0x2000
CHANGE_REASON_BITS = 0x2307

NOISY_EXTENSIONS = [
    "exe", "dll", "sys", "log", "ini", "tmp", "lnk", "pf", "etl", "evtx", "mui", "cat", "man", "xml",
    "dat", "pdb", "cache", "db",
]
