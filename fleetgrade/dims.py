"""Dimensions: categories, severities, profiles, contexts, references, same-rule pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("security", "robustness", "maintainability", "portability", "performance")
SEVERITIES = ("critical", "high", "medium", "low")

# How far the global score may exceed the worst category.
MAX_GAP = 1.5

# Severity weights, reference size and limits of the three profiles.
PROFILES: dict[str, dict] = {
    "standard": {
        "weights": {"critical": 4.0, "high": 2.0, "medium": 0.75, "low": 0.25},
        "reference_lines": 100,
        "thresholds": {"max_line": 120, "max_function": 60, "max_nesting": 4, "max_unstructured": 150},
        "disabled": (),
    },
    "strict": {
        "weights": {"critical": 5.0, "high": 3.0, "medium": 1.0, "low": 0.4},
        "reference_lines": 50,
        "thresholds": {"max_line": 100, "max_function": 40, "max_nesting": 3, "max_unstructured": 100},
        "disabled": (),
    },
    "legacy": {
        "weights": {"critical": 4.0, "high": 1.5, "medium": 0.5, "low": 0.1},
        "reference_lines": 100,
        "thresholds": {"max_line": 160, "max_function": 150, "max_nesting": 6, "max_unstructured": 400},
        "disabled": (
            "MNT001", "MNT004", "MNT005", "MNT010", "FORMAT", "E001", "E002", "E003", "E005", "E006",
            "PYMNT001", "E501", "W291", "W293", "C0301", "C0303",
        ),
    },
}

# Severities raised by execution context.
ESCALATIONS = {
    "root": {
        "SEC004": "critical", "SEC006": "high", "SEC007": "critical", "SC2115": "critical", "SEC009": "high",
        "SEC011": "high", "SEC015": "medium", "SEC019": "high", "ROB001": "high", "ROB005": "high",
        "SC2164": "critical",
    },
    "cron": {"PYROB001": "medium", "ROB001": "high", "SEC009": "high", "SEC012": "medium"},
    "systemd": {"PYROB001": "medium", "ROB001": "high", "SEC012": "medium"},
}

# Analyzers in priority order; the first to report a problem keeps it.
TOOL_PRIORITY = (
    "syntax", "shellcheck", "commands", "bandit", "ruff", "semgrep", "mypy", "pyright", "pylint", "vermin",
    "radon", "pydeps", "pip-audit", "gitleaks", "trufflehog", "checkbashisms", "builtin", "custom",
    "hadolint", "actionlint", "zizmor", "shfmt", "bashate",
)

# Weights of the categories in the global score.
CATEGORY_WEIGHTS = {
    "security": 1.5, "robustness": 1.25, "maintainability": 1.0, "portability": 0.75, "performance": 0.5,
}

# One rule under the codes of two tools.
SAME_AS_BUILTIN = (
    ("SC2164", "ROB005"), ("SC2162", "ROB007"), ("SC2045", "ROB008"), ("SC2115", "SEC007"),
    ("SC2114", "SEC008"), ("SC2006", "MNT007"), ("SC2148", "POR001"), ("SC2230", "POR004"),
    ("SC2196", "POR005"), ("SC2197", "POR005"), ("SC2002", "PERF001"), ("SC2126", "PERF002"),
    ("SC2003", "PERF003"), ("SC2009", "PERF006"), ("SC2116", "PERF008"),
)
SAME_PYTHON = (
    ("E722", "W0702"), ("B006", "W0102"), ("F401", "W0611"), ("F841", "W0612"), ("E401", "C0410"),
    ("F821", "E0602"), ("F811", "E0102"), ("SIM115", "R1732"), ("S307", "W0123"), ("B904", "W0707"),
    ("E501", "C0301"), ("W291", "C0303"), ("C901", "R1260"),
)

# References of the built-in rules (CWE numbers, OWASP entries, ANSSI recommendations).
RULE_REFERENCES: dict[str, tuple[str, ...]] = {
    "SEC001": ("CWE-494", "OWASP A08:2021", "ANSSI-BP-028 R59"),
    "SEC002": ("CWE-798", "OWASP A07:2021"),
    "SEC003": ("CWE-95", "CWE-78", "OWASP A03:2021"),
    "SEC004": ("CWE-732", "OWASP A01:2021", "ANSSI-BP-028 R50", "ANSSI-BP-028 R54"),
    "SEC005": ("CWE-295", "OWASP A07:2021", "ANSSI OpenSSH R6"),
    "SEC006": ("CWE-319", "CWE-494", "OWASP A02:2021", "OWASP A08:2021"),
    "SEC007": ("CWE-73",),
    "SEC009": ("CWE-377", "CWE-59", "ANSSI-BP-028 R55"),
    "SEC010": ("CWE-214",),
    "SEC011": ("CWE-829", "OWASP A08:2021"),
    "SEC012": ("CWE-532", "OWASP A09:2021"),
    "SEC013": ("CWE-250", "ANSSI-BP-028 R56"),
    "SEC014": ("CWE-549",),
    "SEC015": ("CWE-426", "ANSSI-BP-028 R39"),
    "SEC016": ("CWE-427", "ANSSI-BP-028 R39"),
    "SEC017": ("CWE-426",),
    "SEC018": ("CWE-269", "OWASP A01:2021", "ANSSI-BP-028 R50"),
    "SEC019": ("CWE-494", "OWASP A08:2021", "ANSSI-BP-028 R59"),
    "SEC020": ("CWE-668", "ANSSI OpenSSH R20"),
    "SEC021": ("CWE-526",),
    "SEC022": ("CWE-798", "OWASP A07:2021"),
    "SEC023": ("CWE-78", "CWE-94", "OWASP A03:2021", "OWASP CICD-SEC-4"),
    "SEC024": ("CWE-1357", "OWASP A08:2021", "OWASP CICD-SEC-3"),
    "SEC025": ("CWE-347", "CWE-494", "OWASP A08:2021", "OWASP CICD-SEC-3", "ANSSI-BP-028 R59"),
    "SEC026": ("CWE-829", "OWASP A08:2021", "OWASP CICD-SEC-3"),
    "DKR001": ("CWE-1357", "OWASP A08:2021", "OWASP CICD-SEC-3"),
    "DKR002": ("CWE-250", "OWASP A05:2021", "ANSSI-FT-082 R7"),
    "DKR003": ("CWE-494", "OWASP A08:2021", "OWASP CICD-SEC-9"),
    "DKR005": ("CWE-798", "CWE-526", "OWASP A07:2021", "OWASP CICD-SEC-6"),
    "DKR006": ("ANSSI-BP-028 R58",),
    "CI001": ("CWE-829", "CWE-1357", "OWASP A08:2021", "OWASP CICD-SEC-3"),
    "CI002": ("CWE-250", "CWE-272", "OWASP A01:2021", "OWASP CICD-SEC-5"),
    "CI003": ("CWE-829", "CWE-94", "OWASP A08:2021", "OWASP CICD-SEC-4"),
    "CI004": ("CWE-798", "OWASP A07:2021", "OWASP CICD-SEC-6"),
    "CI005": ("CWE-1357", "OWASP A08:2021", "OWASP CICD-SEC-3"),
    "ROB001": ("CWE-252",), "ROB002": ("CWE-252",), "ROB003": ("CWE-457",), "ROB004": ("CWE-459",),
    "ROB005": ("CWE-252",), "ROB011": ("CWE-252",), "ROB013": ("CWE-459",), "ROB014": ("CWE-362",),
    "MNT003": ("CWE-1124",), "MNT006": ("CWE-546",), "POR005": ("CWE-477",), "POR007": ("CWE-477",),
    "PYSEC001": ("CWE-798", "OWASP A07:2021"),
    "PYROB001": ("CWE-1088",), "PYROB003": ("CWE-362",), "PYROB004": ("CWE-393",),
}

# Official titles of the references.
REFERENCE_TITLES = {
    "CWE-59": "Improper Link Resolution Before File Access",
    "CWE-73": "External Control of File Name or Path",
    "CWE-78": "Improper Neutralization of Special Elements used in an OS Command",
    "CWE-94": "Improper Control of Generation of Code",
    "CWE-95": "Improper Neutralization of Directives in Dynamically Evaluated Code",
    "CWE-214": "Invocation of Process Using Visible Sensitive Information",
    "CWE-250": "Execution with Unnecessary Privileges",
    "CWE-252": "Unchecked Return Value",
    "CWE-269": "Improper Privilege Management",
    "CWE-272": "Least Privilege Violation",
    "CWE-295": "Improper Certificate Validation",
    "CWE-319": "Cleartext Transmission of Sensitive Information",
    "CWE-347": "Improper Verification of Cryptographic Signature",
    "CWE-362": "Concurrent Execution using Shared Resource with Improper Synchronization",
    "CWE-377": "Insecure Temporary File",
    "CWE-393": "Return of Wrong Status Code",
    "CWE-426": "Untrusted Search Path",
    "CWE-427": "Uncontrolled Search Path Element",
    "CWE-457": "Use of Uninitialized Variable",
    "CWE-459": "Incomplete Cleanup",
    "CWE-477": "Use of Obsolete Function",
    "CWE-494": "Download of Code Without Integrity Check",
    "CWE-526": "Cleartext Storage of Sensitive Information in an Environment Variable",
    "CWE-532": "Insertion of Sensitive Information into Log File",
    "CWE-546": "Suspicious Comment",
    "CWE-549": "Missing Password Field Masking",
    "CWE-668": "Exposure of Resource to Wrong Sphere",
    "CWE-732": "Incorrect Permission Assignment for Critical Resource",
    "CWE-798": "Use of Hard-coded Credentials",
    "CWE-829": "Inclusion of Functionality from Untrusted Control Sphere",
    "CWE-1088": "Synchronous Access of Remote Resource without Timeout",
    "CWE-1124": "Excessively Deep Nesting",
    "CWE-1357": "Reliance on Insufficiently Trustworthy Component",
    "OWASP A01:2021": "Broken Access Control",
    "OWASP A02:2021": "Cryptographic Failures",
    "OWASP A03:2021": "Injection",
    "OWASP A05:2021": "Security Misconfiguration",
    "OWASP A07:2021": "Identification and Authentication Failures",
    "OWASP A08:2021": "Software and Data Integrity Failures",
    "OWASP A09:2021": "Security Logging and Monitoring Failures",
    "OWASP CICD-SEC-3": "Dependency Chain Abuse",
    "OWASP CICD-SEC-4": "Poisoned Pipeline Execution (PPE)",
    "OWASP CICD-SEC-5": "Insufficient PBAC (Pipeline-Based Access Controls)",
    "OWASP CICD-SEC-6": "Insufficient Credential Hygiene",
    "OWASP CICD-SEC-9": "Improper Artifact Integrity Validation",
}


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def category_rank(category: Column) -> Column:
    return literal_map({c: i for i, c in enumerate(CATEGORIES)})[category]


def severity_rank(severity: Column) -> Column:
    return literal_map({s: i for i, s in enumerate(SEVERITIES)})[severity]


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def load_profile(spark: SparkSession, name: str) -> DataFrame:
    """One config row for a profile."""
    p = PROFILES[name]
    return spark.range(1).select(
        F.lit(name).alias("profile"),
        literal_map(p["weights"]).alias("weights"),
        literal_map(CATEGORY_WEIGHTS).alias("category_weights"),
        F.lit(p["reference_lines"]).alias("reference_lines"),
        literal_map(p["thresholds"]).alias("thresholds"),
        F.array(*[F.lit(d) for d in p["disabled"]]).cast("array<string>").alias("disabled"),
    )


def pair_table(spark: SparkSession) -> DataFrame:
    """Rule pairs of the two fixed tables."""
    return spark.createDataFrame(list(SAME_AS_BUILTIN + SAME_PYTHON), "rule string, same string")


def reference_table(spark: SparkSession) -> DataFrame:
    rows = [(r, ref) for r, refs in RULE_REFERENCES.items() for ref in refs]
    return spark.createDataFrame(rows, "rule string, ref string")


def title_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REFERENCE_TITLES.items()), "ref string, title string")


def escalation_table(spark: SparkSession, contexts: tuple[str, ...]) -> DataFrame:
    rows = [(r, SEVERITIES.index(s)) for c in contexts for r, s in ESCALATIONS[c].items()]
    df = spark.createDataFrame(rows, "rule string, raised int")
    return df.groupBy("rule").agg(F.min("raised").alias("raised"))
