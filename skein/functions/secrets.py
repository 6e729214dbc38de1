"""Credentials in text, as one chain of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import is_program_source, is_sensitive

PREFIXES = {"AKIA": 16, "ASIA": 16, "ghp_": 30, "github_pat_": 20, "xoxb-": 20, "xoxp-": 20, "sk-proj-": 20, "sk-live-": 20, "AIza": 30}
PRIVATE_KEY = "-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"
CLOUD = "|".join(f"{p}[A-Za-z0-9_-]{{{n}}}" for p, n in PREFIXES.items())
MARKERS = ("SECRET", "TOKEN", "PASSWORD", "PRIVATE_KEY", "ACCESS_KEY", "ACCESS_KEY_ID", "SECRET_ACCESS_KEY", "API_KEY")
#: The key must be all that stands before the first = or : of the line.
_KEY = r"^\s*([A-Za-z0-9_.-]*_)?(" + "|".join(MARKERS) + r")\s*[=:]"
_RIGHT = r"^[^=:]*[=:]\s*(.*?)[\s,;]*$"
_OPAQUE = r"^[A-Za-z0-9_.+/=:~-]+$"
_QUOTED = r"""^(?:"([^"]*)"|'([^']*)')\s*(?:$|#.*|//.*)"""


def _placeholder(value: Column) -> Column:
    low = F.lower(value)
    return low.startswith("${") | low.startswith("<") | low.contains("example") | low.contains("placeholder") | low.contains("changeme") | low.contains("your_") | low.rlike("^[*x]*$")


def line_assigns_credential(line: Column, bare: Column) -> Column:
    """Whether a line gives a credential key a literal of eight bytes or more; bare: unquoted words count too."""
    t = F.trim(line)
    value = F.regexp_extract(t, _RIGHT, 1)
    quoted = F.regexp_extract(value, r"""^["']""", 0) != ""
    inner = F.when(value.rlike(_QUOTED), F.concat(F.regexp_extract(value, _QUOTED, 1), F.regexp_extract(value, _QUOTED, 2)))
    literal = F.when(quoted, inner).when(bare & value.rlike(_OPAQUE), value)
    keyed = t.rlike("(?i)" + _KEY) & ~t.startswith("#") & ~t.startswith("//")
    return F.coalesce(keyed & (F.octet_length(literal) >= 8) & ~_placeholder(literal), F.lit(False))


def assigns_credential(path: Column, text: Column) -> Column:
    # Only texts with a marker are cut into lines.
    lines = F.split(text, r"\r?\n")
    some = F.upper(text).rlike("SECRET|TOKEN|PASSWORD|PRIVATE_KEY|ACCESS_KEY|API_KEY")
    return F.when(some, F.exists(lines, lambda line: line_assigns_credential(line, ~F.coalesce(is_program_source(path), F.lit(False))))).otherwise(False)


def finding(path: Column, text: Column) -> Column:
    """The first kind of finding, or null: sensitive_path, private_key, cloud_credential, credential_assignment."""
    return (
        F.when(is_sensitive(path), "sensitive_path")
        .when(text.rlike(PRIVATE_KEY), "private_key")
        .when(text.rlike(CLOUD), "cloud_credential")
        .when(assigns_credential(path, text), "credential_assignment")
    )
