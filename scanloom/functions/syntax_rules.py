"""Python syntax rules: column predicates over one fact (a struct column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions import fixed
from scanloom.functions.line_rules import PY_SQL_WORD
from scanloom.functions.text import has_security_word, names_request_data


def py_network(f: Column) -> Column:
    user_controlled = f["url_kind"].isin("fstr", "add", "subscript") | (
        (f["url_kind"] == "attr") & names_request_data(f["url_dotted"])
    )
    return f["dotted"].isin(*fixed.NETWORK_CALLS) & user_controlled


def py_exec(f: Column) -> Column:
    return f["dotted"].isin(*fixed.EXEC_CALLS) & (f["dotted"].startswith("os.") | f["kw_shell_true"])


def py_sql(f: Column) -> Column:
    built = (f["arg0_kind"] == "fstr") | (
        f["arg0_kind"].isin("binop", "format") & f["arg0_str"].rlike(PY_SQL_WORD)
    )
    return f["attr"].isin("execute", "executemany") & built


def py_weak_random(f: Column) -> Column:
    context = (
        has_security_word(f["line"]) | has_security_word(f["encl_fn"]) | F.exists(f["targets"], has_security_word)
    )
    return f["dotted"].isin(*fixed.RANDOM_CALLS) & context


def py_debug_call(f: Column) -> Column:
    return (f["kind"] == "call") & f["kw_debug_true"]


def py_debug_assign(f: Column) -> Column:
    return (f["kind"] == "assign") & F.array_contains(f["names"], "DEBUG") & f["is_true"]


def py_bare_except(f: Column) -> Column:
    swallows = (f["type_name"] == "Exception") & F.forall(
        f["body_kinds"], lambda kind: kind.isin("Pass", "Continue")
    )
    return (f["kind"] == "handler") & ((f["type_kind"] == "none") | swallows)


# Rule of each predicate in the order they are applied to a fact.
PY_SYNTAX_RULES = (
    ("NO_NETWORK", py_network),
    ("NO_EXEC", py_exec),
    ("SQL_PARAM_BINDING", py_sql),
    ("NO_WEAK_RANDOM", py_weak_random),
    ("NO_DEBUG_MODE", py_debug_call),
    ("NO_DEBUG_MODE", py_debug_assign),
    ("NO_BARE_EXCEPT", py_bare_except),
)
