"""Path admission by ordered ignore rules, and blocking of sensitive content."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.paths import is_control
from skein.functions.secrets import finding
from skein.functions.shared import small


@dataclass(frozen=True)
class Rule:
    """One compiled pattern line. regex matches the path from the repository's root, or any of its parents."""

    order: int
    source: str
    line: int
    pattern: str
    negated: bool
    regex: str
    only_dirs: bool


def glob_regex(pattern: str) -> str:
    """A glob's body as a regular expression: * and ? stay inside a component, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.*", i + 3
            continue
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return out


def compile_rules(sets: list[tuple[str, str | None, str]], fold: bool = False) -> list[Rule]:
    """Rules of (source, base directory, contents) sets in rising precedence; blank lines and comments are skipped."""
    rules = []
    for source, base, contents in sets:
        for number, line in enumerate(contents.split("\n"), 1):
            text = line.rstrip("\r")
            while text.endswith(" ") and not text.endswith("\\ "):
                text = text[:-1]
            if not text or text.startswith("#"):
                continue
            negated = text.startswith("!")
            body = text[1:] if negated else text
            only_dirs = body.endswith("/")
            body = body.rstrip("/")
            if not body:
                continue
            anchored = "/" in body
            body = body.lstrip("/")
            prefix = re.escape(base.rstrip("/")) + "/" if base else ""
            regex = ("(?i)" if fold else "") + "^" + prefix + ("" if anchored else "(?:.*/)?") + glob_regex(body) + "$"
            rules.append(Rule(len(rules), source, number, text, negated, regex, only_dirs))
    return rules


def _decider(rules: list[Rule]):
    """Numbers of the deciding rules of paths: (last rule that matches the path, first ignored ancestor's rule), -1 for none.

    Patterns are compiled once a task and looked at from the last on, so the first hit decides; what was found for a directory
    is kept, since many paths share it. The plan doesn't grow with the rules.
    """
    texts = [(r.regex, r.only_dirs) for r in rules]
    negated = [r.negated for r in rules]

    def run(batches):
        compiled = [(k, re.compile(x), d) for k, (x, d) in reversed(list(enumerate(texts)))]
        known: dict[str, int] = {}

        def last(p: str, is_dir: bool) -> int:
            return next((k for k, x, d in compiled if (is_dir or not d) and x.search(p)), -1)

        def above(p: str) -> int:
            at = p.find("/")
            while at >= 0:
                directory = p[:at]
                if directory not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[directory] = last(directory, True) if directory else -1
                if (k := known[directory]) >= 0 and not negated[k]:
                    return k
                at = p.find("/", at + 1)
            return -1

        for batch in batches:
            names = batch.column(batch.num_columns - 2).to_pylist()
            dirs = batch.column(batch.num_columns - 1).to_pylist()
            own = [-1 if p is None else last(p, bool(d)) for p, d in zip(names, dirs)]
            up = [-1 if p is None else above(p) for p in names]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(own, pa.int32()), pa.array(up, pa.int32())], names=[*batch.schema.names[:-2], "__own", "__above"])

    return run


def decide(paths: DataFrame, rules: list[Rule], path: str = "path", controls: tuple[str, ...] = ()) -> DataFrame:
    """paths (path, is_dir, tracked) with decision, reason, source, line, pattern.

    In order: version control's own paths are refused, tracked ones admitted, an ignored ancestor beats a later
    re-inclusion of the child, then the last matching rule, else admitted. Rules may be thousands.
    """
    p = F.col(path)
    kind = T.StructType([*paths.schema.fields, T.StructField("__own", T.IntegerType()), T.StructField("__above", T.IntegerType())])
    found = paths.select("*", p.cast("string").alias("__p"), F.col("is_dir").alias("__d")).mapInArrow(_decider(rules), kind)
    named = paths.sparkSession.createDataFrame([(r.order, r.source, r.line, r.pattern, r.negated) for r in rules], "__rule int, source string, line int, pattern string, __negated boolean")
    reason = F.when(is_control(p, controls), "control").when(F.col("tracked"), "tracked").when(F.col("__above") >= 0, "ignored ancestor").when(F.col("__own") >= 0, "rule").otherwise("default")
    rule = F.when(reason == "ignored ancestor", F.col("__above")).when(reason == "rule", F.col("__own")).otherwise(-1)
    out = found.withColumn("reason", reason).withColumn("__rule", rule).join(small(named), "__rule", "left")
    admitted = F.col("reason").isin("tracked", "default") | ((F.col("reason") == "rule") & F.col("__negated"))
    return out.select(*[F.col(f"`{c}`") for c in paths.columns], F.when(admitted, "admit").otherwise("refuse").alias("decision"), "reason", "source", "line", "pattern")


def rule_set_problems(sets: list[dict]) -> list[str]:
    """Of rule sets (source, precedence, base, contents, content_hash, content_len)."""
    out, seen = [], set()
    for i, s in enumerate(sorted(sets, key=lambda s: s["precedence"])):
        raw = s["contents"].encode()
        if s["precedence"] != i:
            out.append(f"precedence {s['precedence']} isn't {i}")
        if s["source"] in seen:
            out.append(f"source {s['source']} comes twice")
        seen.add(s["source"])
        if len(raw) != s["content_len"] or hashlib.sha256(raw).hexdigest() != s["content_hash"]:
            out.append(f"contents of {s['source']} don't match their hash")
        if s.get("base") and (s["base"].startswith("/") or s["base"].endswith("/")):
            out.append(f"base directory {s['base']}")
    return out


def policy_hash(sets: list[dict]) -> str:
    """One hash for all rule sets in order, fields with their lengths."""
    h = hashlib.sha256(b"admission-policy-v1:")
    for s in sorted(sets, key=lambda s: s["precedence"]):
        for v in (s["source"], str(s["precedence"]), s.get("base") or "", s["content_hash"]):
            h.update(len(v.encode()).to_bytes(8, "big") + v.encode())
    return h.hexdigest()


def enforce(files: DataFrame, allowances: DataFrame) -> DataFrame:
    """files (path, content, content_hash, kind, tracked) with `verdict`: digest mismatch, tracked, clean, allowed, or blocked with the finding."""
    found = finding(F.col("path"), F.col("content"))
    allow = allowances.select("path", "content_hash", "kind").distinct().withColumn("__allowed", F.lit(True))
    j = files.withColumn("finding", found).join(allow, ["path", "content_hash", "kind"], "left")
    verdict = (
        F.when(F.sha2(F.col("content").cast("binary"), 256) != F.col("content_hash"), "digest mismatch")
        .when(F.col("tracked"), "tracked")
        .when(F.col("finding").isNull(), "clean")
        .when(F.col("__allowed"), "allowed")
        .otherwise("blocked")
    )
    return j.withColumn("verdict", verdict).drop("__allowed")
