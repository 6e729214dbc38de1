"""Name patterns and identifier tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_pattern(pattern: str) -> tuple[str, str]:
    """(mode, needle): a leading star makes a suffix, else a trailing star a prefix, else any place. Stars inside are literal."""
    low = pattern.lower()
    if low.startswith("*"):
        return "suffix", low[1:]
    if low.endswith("*"):
        return "prefix", low[:-1]
    return "contains", low


def name_matches(name: Column, pattern: str) -> Column:
    mode, needle = compile_pattern(pattern)
    low = F.lower(name)
    return {"suffix": low.endswith, "prefix": low.startswith, "contains": low.contains}[mode](needle)


# Letters of any script with their marks, and digits.
_HUMP, _CAPS, _REST = r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"[^\p{L}\p{M}\p{N}]+"


def tokens(name: Column) -> Column:
    """Lower-case pieces of camelCase, snake_case and paths, with repeats."""
    spaced = F.regexp_replace(F.regexp_replace(name, _HUMP, "$1 $2"), _CAPS, "$1 $2")
    return F.filter(F.split(F.lower(spaced), _REST), lambda t: t != "")


def tokens_sql(expr: str) -> str:
    inner = rf"regexp_replace(regexp_replace({expr}, '{_HUMP}', '\1 \2', 'g'), '{_CAPS}', '\1 \2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({inner}), '{_REST}'), lambda t: t <> '')"


def python_tokens(text: str) -> list[str]:
    import regex

    text = regex.sub(_CAPS, r"\1 \2", regex.sub(_HUMP, r"\1 \2", text))
    return [t for t in regex.split(_REST, text.lower()) if t]
