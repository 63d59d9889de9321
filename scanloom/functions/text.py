"""Scalar text functions. All of them are built-in Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions import fixed

# Word and blank classes of Unicode text, spelled out so that results do not
# depend on the Java version (``\b``, ``\w`` and ``\s`` differ between releases).
WORD = r"\p{L}\p{N}_"
NOT_AFTER_WORD = rf"(?<![{WORD}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RARE_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
FENCE = r"(?s)```(?:[a-zA-Z0-9_+-]+)?\n(.*?)```"


def _any_word(words) -> str:
    return "|".join(re.escape(w) for w in words)


def detect_language(path: Column) -> Column:
    """Language of a file by its ending; ``unknown`` for all others."""
    name = F.substring_index(path, "/", -1)
    ending = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    pairs = [F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ending), F.lit("unknown"))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 text; malformed bytes become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def universal_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``, as when a file is read in text mode."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def raw_lines(text: Column) -> Column:
    """Lines as an array. A final line break leaves an empty last element.

    Most texts know only ``\\n``, for which splitting needs no pattern.
    """
    rare = F.lit(False)
    for line_break in RARE_LINE_BREAKS:
        rare = rare | F.contains(text, F.lit(line_break))
    return F.when(rare, F.split(text, LINE_BREAK, -1)).otherwise(F.split(text, "\n", -1))


def with_value(value: Column, body) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """Lines as an array, without the empty element after a final line break."""
    return with_value(
        raw_lines(text),
        lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines),
    )


def strip_right(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!{BLANK}){BLANK}++\z", "")


def strip_both(text: Column) -> Column:
    return F.regexp_replace(strip_right(text), rf"\A{BLANK}++", "")


def snippet(lines: Column, line_no: Column) -> Column:
    """Right-stripped line by its number from 1; empty when out of range."""
    return F.coalesce(strip_right(F.get(lines, line_no - 1)), F.lit(""))


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike(_any_word(fixed.PLACEHOLDER_WORDS))


def has_security_word(text: Column) -> Column:
    return F.lower(text).rlike(_any_word(fixed.SECURITY_WORDS))


def names_request_data(dotted: Column) -> Column:
    return F.lower(dotted).rlike(_any_word(fixed.REQUEST_WORDS))


def canonical_rule_id(rule_id: Column) -> Column:
    """Rule id for an alias; any other id is returned unchanged."""
    pairs = [F.lit(x) for pair in fixed.RULE_ALIASES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rule_id), rule_id)


def mask_secret(value: Column) -> Column:
    return F.when(F.char_length(value) <= 8, F.lit("***REDACTED***")).otherwise(
        F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4)))
    )


_REDACT_ASSIGN = (
    rf"(?iu)({NOT_AFTER_WORD}(?:{fixed.PY_SECRET_NAMES}){NOT_BEFORE_WORD}{BLANK}*={BLANK}*[\"'])"
    r"([^\"']{4,})([\"'])"
)
_QUOTED_VALUE = rf"={BLANK}*+[\"'][^\"']{{4,}}+[\"']"
_REDACT_TOKEN = (
    r"(sk-[A-Za-z0-9])[A-Za-z0-9]{15,}([A-Za-z0-9]{4})"
    r"|(ghp_)[A-Za-z0-9]{32}([A-Za-z0-9]{4})"
    r"|(AKIA)[0-9A-Z]{12}([0-9A-Z]{4})"
)


def redact(text: Column) -> Column:
    """Mask assigned secrets, then provider tokens, anywhere in a text.

    The text is cut at the assignments and put together again with masked
    values, so every assignment is masked once, in one pass from the left.
    """
    between = F.split(text, _REDACT_ASSIGN, -1)
    found = F.regexp_extract_all(text, F.lit(_REDACT_ASSIGN), F.lit(0))

    def masked(match: Column) -> Column:
        return F.concat(
            F.regexp_extract(match, _REDACT_ASSIGN, 1),
            mask_secret(F.regexp_extract(match, _REDACT_ASSIGN, 2)),
            F.regexp_extract(match, _REDACT_ASSIGN, 3),
        )

    joined = F.array_join(
        F.zip_with(between, found, lambda b, m: F.concat(b, F.when(m.isNull(), "").otherwise(masked(m)))), ""
    )
    # Cheap necessary conditions keep the patterns away from most texts.
    may_assign = F.contains(text, F.lit("=")) & text.rlike(_QUOTED_VALUE)
    may_hold_token = F.contains(text, F.lit("sk-")) | F.contains(text, F.lit("ghp_")) | F.contains(text, F.lit("AKIA"))

    def tokens_masked(s: Column) -> Column:
        return F.when(may_hold_token, F.regexp_replace(s, _REDACT_TOKEN, "$1$3$5...$2$4$6")).otherwise(s)

    return F.when(may_assign, tokens_masked(joined)).otherwise(tokens_masked(text))


def extract_code(text: Column) -> Column:
    """The longest fenced block of a response (first of equals), or the whole text."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    longest = F.aggregate(
        blocks,
        F.lit(None).cast("string"),
        lambda best, block: F.when(
            best.isNull() | (F.char_length(block) > F.char_length(best)), block
        ).otherwise(best),
    )
    plain = strip_both(text)
    return F.when(longest.isNotNull(), F.concat(strip_both(longest), F.lit("\n"))).otherwise(
        F.when(plain == "", "").otherwise(F.concat(plain, F.lit("\n")))
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
