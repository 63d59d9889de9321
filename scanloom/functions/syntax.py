"""Facts about Python syntax, extracted once per file in Arrow workers.

A fact describes one call, assignment or exception handler. It carries no
verdict: the rules are column predicates in ``syntax_rules``. With
``focus=True`` facts that no rule can use are left out, which keeps the data
returned from the workers small; ``focus=False`` gives every fact.
"""

from __future__ import annotations

import ast
import re
import sys
import warnings
from collections import deque
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import fixed

# The helpers below travel to the workers with the query, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("line", T.StringType()),
        T.StructField("dotted", T.StringType()),
        T.StructField("attr", T.StringType()),
        T.StructField("arg0_kind", T.StringType()),
        T.StructField("arg0_op", T.StringType()),
        T.StructField("arg0_str", T.StringType()),
        T.StructField("url_kind", T.StringType()),
        T.StructField("url_dotted", T.StringType()),
        T.StructField("kw_shell_true", T.BooleanType()),
        T.StructField("kw_debug_true", T.BooleanType()),
        T.StructField("encl_fn", T.StringType()),
        T.StructField("targets", T.ArrayType(T.StringType())),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("is_true", T.BooleanType()),
        T.StructField("type_kind", T.StringType()),
        T.StructField("type_name", T.StringType()),
        T.StructField("body_kinds", T.ArrayType(T.StringType())),
        T.StructField("message", T.StringType()),
        T.StructField("col", T.IntegerType()),
    ]
)
FACTS = T.ArrayType(FACT)

_ARROW = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}
_ARROW_FACT = pa.struct(
    [(f.name, _ARROW.get(f.dataType) or pa.list_(pa.string())) for f in FACT.fields]
)
_NAMES = [f.name for f in FACT.fields]

_WATCHED = frozenset(fixed.NETWORK_CALLS + fixed.EXEC_CALLS + fixed.RANDOM_CALLS)
_EXECUTES = ("execute", "executemany")

# What a text must hold for a rule to apply. Conditions are necessary ones only, the rules themselves look at the facts.
# ASCII text only: other identifiers are normalised by the Python parser.
_NETWORK = tuple(sorted({call.split(".")[0] for call in fixed.NETWORK_CALLS}))
_SHELLS = tuple(sorted({call.split(".")[0] for call in fixed.EXEC_CALLS if not call.startswith("os.")}))
_OS_CALLS = tuple(call.split(".")[1] for call in fixed.EXEC_CALLS if call.startswith("os."))
_SECURITY = fixed.SECURITY_WORDS
_SWALLOWS = re.compile(r"except[\s\\]*:|Exception")
_BUILT = re.compile(r"""[fF][rR]?["']|[%+]|format""")


def _may_matter(text: str) -> bool:
    if not text.isascii() or any(word in text for word in _NETWORK):
        return True
    if "True" in text and ("DEBUG" in text or "debug" in text or "shell" in text and any(word in text for word in _SHELLS)):
        return True
    if "except" in text and _SWALLOWS.search(text) or "execute" in text and _BUILT.search(text):
        return True
    if "os" in text and any(word in text for word in _OS_CALLS):
        return True
    return "random" in text and any(word in text.lower() for word in _SECURITY)


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _is_true(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and node.value is True


def _text(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _call_fact(node: ast.Call, dotted: str, focus: bool) -> dict | None:
    attr = node.func.attr if isinstance(node.func, ast.Attribute) else None
    keywords = {}
    for kw in node.keywords:
        if kw.arg in ("shell", "debug"):
            # A keyword given twice parses; one that is true is enough.
            keywords[kw.arg] = keywords.get(kw.arg, False) or _is_true(kw.value)
        elif kw.arg in ("url", "endpoint"):
            keywords.setdefault("url", kw.value)
    fact = {
        "kind": "call",
        "dotted": dotted,
        "attr": attr,
        "kw_shell_true": keywords.get("shell", False),
        "kw_debug_true": keywords.get("debug", False),
    }
    if focus and not (dotted in _WATCHED or attr in _EXECUTES or fact["kw_debug_true"]):
        return None

    url = node.args[0] if node.args else None
    if dotted.endswith(".request") and len(node.args) > 1:
        url = node.args[1]
    url = keywords.get("url", url)
    match url:
        case None:
            pass
        case ast.JoinedStr():
            fact["url_kind"] = "fstr"
        case ast.BinOp(op=ast.Add()):
            fact["url_kind"] = "add"
        case ast.Subscript():
            fact["url_kind"] = "subscript"
        case ast.Attribute():
            fact["url_kind"], fact["url_dotted"] = "attr", _dotted(url)
        case _:
            fact["url_kind"] = "other"

    match node.args:
        case []:
            pass
        case [ast.JoinedStr(), *_]:
            fact["arg0_kind"] = "fstr"
        case [ast.BinOp(left=left, op=ast.Mod() | ast.Add() as op), *_]:
            fact["arg0_kind"], fact["arg0_str"] = "binop", _text(left)
            fact["arg0_op"] = "mod" if isinstance(op, ast.Mod) else "add"
        case [ast.Call(func=ast.Attribute(value=base, attr="format")), *_]:
            fact["arg0_kind"], fact["arg0_str"] = "format", _text(base)
        case _:
            fact["arg0_kind"] = "other"
    return fact


def _assign_fact(node: ast.Assign, focus: bool) -> dict | None:
    names = [t.id for t in node.targets if isinstance(t, ast.Name)]
    if focus and "DEBUG" not in names:
        return None
    return {"kind": "assign", "names": names, "is_true": _is_true(node.value)}


def _handler_fact(node: ast.ExceptHandler, focus: bool) -> dict | None:
    type_name = node.type.id if isinstance(node.type, ast.Name) else None
    if focus and node.type is not None and type_name != "Exception":
        return None
    return {
        "kind": "handler",
        "type_kind": "none" if node.type is None else "name" if type_name else "other",
        "type_name": type_name,
        "body_kinds": [type(s).__name__ for s in node.body],
    }


def _target_names(node: ast.AST) -> tuple[str, ...]:
    match node:
        case ast.Assign(targets=targets):
            return tuple(t.id.lower() for t in targets if isinstance(t, ast.Name))
        case ast.AnnAssign(target=ast.Name(id=name)):
            return (name.lower(),)
    return ()


def _parse(text: str) -> tuple[ast.AST | None, dict | None]:
    """Syntax tree of a text, or a ``syntax_error`` fact if it is not valid Python."""
    try:
        return ast.parse(text), None
    except SyntaxError as problem:
        message, line, col = problem.msg, problem.lineno or 0, problem.offset or 0
    except (ValueError, RecursionError, MemoryError) as problem:
        message, line, col = str(problem) or type(problem).__name__, 0, 0
    return None, {"kind": "syntax_error", "lineno": line, "message": message, "col": col, "seq": 0}


# Nodes below which there is nothing to report.
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop, ast.alias)


_NODES = frozenset(
    kind for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST) and not issubclass(kind, _LEAVES)
)
# Fields that hold leaves or no nodes.
_PLAIN = frozenset(
    "ctx op ops id attr arg name names module level kind conversion is_async simple type_comment type_ignores".split()
)
_FIELDS = {kind: tuple(name for name in kind._fields if name not in _PLAIN) for kind in _NODES}


def extract_facts(text: str, focus: bool = False, problems: bool = True) -> list[dict]:
    """Facts of one file in breadth-first order of its syntax tree.

    With ``focus`` and without ``problems``, texts that no rule can apply to are not parsed.
    """
    if focus and not problems and not _may_matter(text):
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    tree, problem = _parse(text)
    if problem:
        return [problem] if problems else []
    if focus and not _may_matter(text):
        return []

    lines = None
    facts = []
    # What surrounds a node travels down with it: function name, target names.
    todo = deque([(tree, "", ())])
    seq = 0
    while todo:
        node, function, targets = todo.popleft()
        kind = type(node)
        fact = None
        if kind is ast.Call:
            fact = _call_fact(node, _dotted(node.func), focus)
        elif kind is ast.Assign:
            fact = _assign_fact(node, focus)
        elif kind is ast.ExceptHandler:
            fact = _handler_fact(node, focus)
        if fact:
            lines = text.splitlines() if lines is None else lines
            inside = 0 < node.lineno <= len(lines)
            fact["line"] = lines[node.lineno - 1].rstrip() if inside else ""
            fact |= {"seq": seq, "lineno": node.lineno, "encl_fn": function, "targets": targets}
            facts.append(fact)
        seq += 1
        if kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            function = node.name.lower()
        elif kind is ast.Assign or kind is ast.AnnAssign:
            targets += _target_names(node)
        for name in _FIELDS[kind]:
            value = getattr(node, name, None)
            if type(value) is list:
                todo.extend([(item, function, targets) for item in value if type(item) in _NODES])
            elif type(value) in _NODES:
                todo.append((value, function, targets))
    return facts


@contextmanager
def _quiet():
    """Parsing warns of odd literals in the scanned code; workers keep silent."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        yield


def _facts_udf(focus: bool, problems: bool = True):
    @F.arrow_udf(FACTS)
    def py_facts(texts: pa.Array) -> pa.Array:
        offsets, facts = [0], []
        with _quiet():
            for text in texts.to_pylist():
                if text is not None:
                    facts.extend(extract_facts(text, focus, problems))
                offsets.append(len(facts))
        columns = [
            pa.array([f.get(name) for f in facts], type=_ARROW_FACT.field(name).type) for name in _NAMES
        ]
        rows = pa.StructArray.from_arrays(columns, fields=list(_ARROW_FACT))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return py_facts


def facts_column(text: Column, focus: bool = True, problems: bool = True) -> Column:
    """Array of facts; empty for a null text. Without ``problems``, what cannot be parsed has no facts."""
    return _facts_udf(focus, problems)(text)


PROBLEM = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
    ]
)


@F.arrow_udf(PROBLEM)
def _problem_udf(texts: pa.Array) -> pa.Array:
    with _quiet():
        found = [None if t is None else _parse(t)[1] for t in texts.to_pylist()]
    return pa.array(
        [f and {"message": f["message"], "line": f["lineno"], "col": f["col"]} for f in found],
        type=pa.struct([("message", pa.string()), ("line", pa.int32()), ("col", pa.int32())]),
    )


def problem_column(text: Column) -> Column:
    """Syntax problem of a Python text, null if there is none."""
    return _problem_udf(text)


def register_py_facts(spark) -> None:
    """``py_facts(text)`` for SQL, an array of facts: ``SELECT * FROM files, LATERAL inline(py_facts(files.text))``."""
    spark.udf.register("py_facts", _facts_udf(False))


_FACT_ROW = T.StructType([T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), *FACT.fields])


class _FactRows:
    """Facts of the files of a table, a row each."""

    def eval(self, files: pa.RecordBatch):
        held = {name.lower(): files.column(i).to_pylist() for i, name in enumerate(files.schema.names)}
        rows = []
        with _quiet():
            for repo, path, text in zip(held.get("repo", [None] * files.num_rows), held["path"], held["text"], strict=True):
                rows += [{"repo": repo, "path": path, **fact} for fact in extract_facts(text)] if text is not None else []
        yield pa.table(
            {
                "repo": pa.array([r["repo"] for r in rows], pa.string()),
                "path": pa.array([r["path"] for r in rows], pa.string()),
                **{name: pa.array([r.get(name) for r in rows], _ARROW_FACT.field(name).type) for name in _NAMES},
            }
        )


def register_py_fact_rows(spark) -> None:
    """``py_fact_rows``, a table function for SQL.

    ``SELECT * FROM py_fact_rows(TABLE(files) PARTITION BY path)`` gives repo, path and the facts of every Python text, one
    row a fact; ``files`` has path, text and perhaps repo. Without ``PARTITION BY`` use ``WITH SINGLE PARTITION`` only for
    small tables: it is one task. Null texts have no facts.
    """
    spark.udtf.register("py_fact_rows", F.arrow_udtf(_FactRows, returnType=_FACT_ROW))
