"""Line rules: each function turns a line of code into a boolean column.

They are plain expressions, so the same function serves an exploded table of
lines and a lambda over an array of lines. Cheap necessary conditions
(``contains``) come before the patterns; they never change the answer.
Possessive and atomic groups keep matching linear on minified one-line files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions import fixed
from scanloom.functions.text import BLANK, NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD, is_placeholder, has_security_word

_QUOTED = rf"{BLANK}*={BLANK}*([\"'])([^\"']{{4,}})\1"

_PY_ASSIGN = rf"(?iu){NOT_AFTER_WORD}(?:{fixed.PY_SECRET_NAMES}){NOT_BEFORE_WORD}{_QUOTED}"

# One try per run of identifier characters: something that can begin a name,
# then the keyword further right in the same run.
_IDENT = rf"[{WORD}$]"
_JS_ASSIGN = (
    rf"(?iu)(?<!{_IDENT})[{WORD}$&&[^A-Za-z_$]]*[A-Za-z_$]{_IDENT}*?(?:{fixed.JS_SECRET_NAMES}){_IDENT}*+{_QUOTED}"
)

_JS_NETWORK = (
    rf"{NOT_AFTER_WORD}(fetch|axios\.(?:get|post|put|delete|patch)|https?\.(?:get|request)){BLANK}*\(([^),]*)"
)
_JS_EXEC = (
    rf"(?:child_process\.(?:exec|execSync|spawnSync)|(?<![.{WORD}])(?:execSync|spawnSync|exec)){BLANK}*\("
)
_JS_SQL_WORD = rf"{NOT_AFTER_WORD}(?:{'|'.join(fixed.JS_SQL_WORDS)}){NOT_BEFORE_WORD}"
_JS_SQL_TEMPLATE = rf"(?iu)`(?>[^`]*?{_JS_SQL_WORD})[^`]*?\$\{{"
_JS_SQL_CONCAT = rf"(?iu)^(?>.*?{_JS_SQL_WORD}).*(?:\+|concat\()"
_JS_DEBUG = rf"(?iu){NOT_AFTER_WORD}debug{BLANK}*[:=]{BLANK}*true{NOT_BEFORE_WORD}"
_JS_RANDOM = rf"Math\.random{BLANK}*\("
_MARKERS = "|".join(m.replace(".", r"\.").replace("$", r"\$").replace("{", r"\{") for m in fixed.JS_REQUEST_MARKERS)

EMPTY_CATCH = rf"catch{BLANK}*+\([^)]*\){BLANK}*+\{{{BLANK}*+\}}"
PY_SQL_WORD = rf"(?iu){NOT_AFTER_WORD}(?:{'|'.join(fixed.PY_SQL_WORDS)}){NOT_BEFORE_WORD}"


def _assigned(line: Column, pattern: str) -> Column:
    value = F.regexp_extract(line, pattern, 2)
    quoted = F.contains(line, F.lit('"')) | F.contains(line, F.lit("'"))
    return F.contains(line, F.lit("=")) & quoted & (value != "") & ~is_placeholder(value)


def _provider(line: Column, shapes: dict[str, str]) -> Column:
    hit = F.lit(False)
    for start, pattern in shapes.items():
        token = F.regexp_extract(line, pattern, 0)
        hit = hit | (F.contains(line, F.lit(start)) & (token != "") & ~is_placeholder(token))
    return hit


def py_secret_assigned(line: Column) -> Column:
    return _assigned(line, _PY_ASSIGN)


def py_provider_secret(line: Column) -> Column:
    return _provider(
        line,
        {
            "sk-": fixed.SK_TOKEN_PY,
            "ghp_": fixed.GHP_TOKEN,
            "AKIA": fixed.AKIA_TOKEN,
            "-----BEGIN ": fixed.PEM_HEADER,
            "eyJ": fixed.JWT_TOKEN,
        },
    )


def py_secret(line: Column) -> Column:
    return py_secret_assigned(line) | py_provider_secret(line)


def js_secret_assigned(line: Column) -> Column:
    return _assigned(line, _JS_ASSIGN)


def js_provider_secret(line: Column) -> Column:
    return _provider(
        line,
        {
            "sk-": fixed.SK_TOKEN_JS,
            "ghp_": fixed.GHP_TOKEN,
            "AKIA": fixed.AKIA_TOKEN,
            "-----BEGIN ": fixed.PEM_HEADER,
        },
    )


def first_argument(line: Column) -> Column:
    """Text between the first network call's bracket and the next ``)`` or ``,``."""
    return F.trim(F.regexp_extract(line, _JS_NETWORK, 2))


def js_network(line: Column) -> Column:
    return F.contains(line, F.lit("(")) & F.regexp_extract(line, _JS_NETWORK, 2).rlike(_MARKERS)


def js_exec(line: Column) -> Column:
    return (F.contains(line, F.lit("exec")) | F.contains(line, F.lit("spawnSync"))) & line.rlike(_JS_EXEC)


def js_sql(line: Column) -> Column:
    template = F.contains(line, F.lit("`")) & F.contains(line, F.lit("${")) & line.rlike(_JS_SQL_TEMPLATE)
    joins = F.contains(line, F.lit("+")) | F.contains(F.lower(line), F.lit("concat("))
    return template | (joins & line.rlike(_JS_SQL_CONCAT))


def js_debug(line: Column) -> Column:
    return F.contains(F.lower(line), F.lit("debug")) & line.rlike(_JS_DEBUG)


def js_weak_random(line: Column) -> Column:
    return F.contains(line, F.lit("Math.random")) & line.rlike(_JS_RANDOM) & has_security_word(line)


# Rule of each line test in the order they are applied to a line. A secret
# assignment ends the work on a JavaScript line.
JS_LINE_RULES = (
    ("NO_HARDCODED_SECRETS", js_provider_secret),
    ("NO_NETWORK", js_network),
    ("NO_EXEC", js_exec),
    ("SQL_PARAM_BINDING", js_sql),
    ("NO_DEBUG_MODE", js_debug),
    ("NO_WEAK_RANDOM", js_weak_random),
)
