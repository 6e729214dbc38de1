"""Predicates on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_DIRS = ("test", "tests", "testing", "example", "examples", "bench", "benches", "benchmark", "benchmarks")
TEST_SUFFIXES = ("_test.py", "_test.rs", "_test.go", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx")
#: Components that belong to version control itself. Callers add their own with `extra`.
CONTROL = (".git", ".git-export", ".hg", ".svn")
SECRET_NAMES = ("id_rsa", "id_ed25519", "credentials", "credentials.json", "service-account.json")
SOURCE_EXTENSIONS = (
    "rs py pyi js jsx mjs cjs ts tsx mts cts go java kt kts scala rb php swift c h cc cpp cxx hpp hxx hh cs m mm dart ex exs erl hrl hs lua pl pm zig nim jl groovy clj cljs cljc fs fsx ml mli vue svelte"
).split()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_nonproduction(path: Column) -> Column:
    """Tests, examples and benchmarks by file name or any directory; null paths aren't."""
    p = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    name = base_name(p)
    dirs = F.exists(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), lambda d: d.isin(*TEST_DIRS))
    by_name = (name == "conftest.py") | name.startswith("test_")
    for s in TEST_SUFFIXES:
        by_name = by_name | name.endswith(s)
    return F.coalesce(by_name | dirs, F.lit(False))


def is_nonproduction_sql(path: str) -> str:
    p = f"replace(lower({path}), '\\', '/')"
    name = f"list_extract(string_split({p}, '/'), -1)"
    suffix = " OR ".join(f"ends_with({name}, '{s}')" for s in TEST_SUFFIXES)
    dirs = ", ".join(f"'{d}'" for d in TEST_DIRS)
    return f"coalesce({name} = 'conftest.py' OR starts_with({name}, 'test_') OR {suffix} OR list_has_any(string_split({p}, '/')[:-2], [{dirs}]), false)"


def is_magic_method(kind: Column, name: Column) -> Column:
    last = F.element_at(F.split(name, r"\."), -1)
    return F.coalesce((kind == "method") & last.startswith("__") & last.endswith("__"), F.lit(False))


def is_control(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Any component is one of version control's own, whatever its case."""
    return F.exists(F.split(F.lower(path), "/"), lambda c: c.isin(*CONTROL, *extra))


def is_sensitive(path: Column) -> Column:
    n = F.lower(base_name(path))
    template = n.startswith(".env.") & (n.endswith(".example") | n.endswith(".sample") | n.endswith(".template"))
    return ~template & ((n == ".env") | n.startswith(".env.") | n.endswith(".pem") | n.endswith(".key") | n.isin(*SECRET_NAMES))


def is_program_source(path: Column) -> Column:
    n = base_name(path)
    return n.contains(".") & F.lower(F.element_at(F.split(n, r"\."), -1)).isin(*SOURCE_EXTENSIONS)
