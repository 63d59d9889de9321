from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.functions import text
from scanloom.operators.scan import split_lines


def apply(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in frame.orderBy("i").select(function(F.col("v"))).collect()]


def test_lines_are_those_of_splitlines(spark, files):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef", "a\x85b\u2028c\u2029d", "é\tü \n x"]
    made = files({f"{i}.py": t for i, t in enumerate(texts)})
    rows = split_lines(made).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.line_no, r.line) for r in rows if r.path == f"{i}.py")
        assert mine == list(enumerate(t.splitlines(), 1)), repr(t)


def test_snippet_is_stripped_on_the_right_and_empty_out_of_range(spark):
    frame = spark.createDataFrame([("  a \t \x1f\nb",)], "v string")
    lines = text.lines_of(F.col("v"))
    row = frame.select(
        text.snippet(lines, F.lit(1)), text.snippet(lines, F.lit(2)), text.snippet(lines, F.lit(3)), text.snippet(lines, F.lit(0))
    ).first()
    assert tuple(row) == ("  a", "b", "", "")


def test_language_by_ending(spark):
    paths = ["a.py", "A.PY", "x/b.jsx", "b.ts", "c.TSX", "d.js", "py", ".py", "a.pyc", "d.js/readme", "a.b.ts"]
    want = ["python", "python", "javascript", "typescript", "typescript", "javascript", "unknown", "unknown", "unknown", "unknown", "typescript"]
    assert apply(spark, paths, text.detect_language) == want


def test_bytes_become_text_with_replacement(spark):
    frame = spark.createDataFrame([(bytearray(b"a\xff\xfeb"),), (bytearray("é".encode()),)], T.StructType([T.StructField("b", T.BinaryType())]))
    assert [r[0] for r in frame.select(text.decode_text(F.col("b"))).collect()] == [b"a\xff\xfeb".decode("utf-8", "replace"), "é"]


def test_placeholders_and_security_words(spark):
    assert apply(spark, ["myEXAMPLEkey", "a1b2", "xxxxx", "your_api_key"], text.is_placeholder) == [True, False, True, True]
    assert apply(spark, ["const Token", "authors", "dice"], text.has_security_word) == [True, True, False]


def test_aliases(spark):
    assert apply(spark, ["WEAK_HASH", "SQL_INJECTION", "OTHER"], text.canonical_rule_id) == ["NO_WEAK_RANDOM", "SQL_PARAM_BINDING", "OTHER"]


def test_redaction(spark):
    sk, ghp, akia = "sk-" + "a1" * 12, "ghp_" + "b" * 36, "AKIA" + "C" * 16
    texts = [
        'token = "abcd"', "token='abcdefgh'", 'x = 1\npassword = "abcdefghi"\nsecret="q\nrst"', 'token="pwd="xxxxxxxxx"',
        f"k = {sk}", f"{ghp} and {akia}.", f'token = "{sk}"', 'my_token = "abcdef"', 'Password = "äöüßäöüßäöüß"',
        "éépassword = 'abcdefgh'", "é password = 'abcdefghij'", "", "nothing", f"{sk[:20]}", "a$1 token = 'a$1\\\\2bcdefgh'",
        'token = "12345678" token = "123456789"', "ghp_" + "x" * 34 + "sk-" + "y" * 25,
    ]
    shown = [
        'token = "***REDACTED***"',
        "token='***REDACTED***'",
        'x = 1\npassword = "abcd...fghi"\nsecret="***REDACTED***"',
        'token="***REDACTED***"xxxxxxxxx"',
        'k = sk-a...a1a1',
        'ghp_...bbbb and AKIA...CCCC.',
        'token = "sk-a...a1a1"',
        'my_token = "abcdef"',
        'Password\xa0=\xa0"äöüß...äöüß"',
        "éépassword = 'abcdefgh'",
        "é password = 'abcd...ghij'",
        '',
        'nothing',
        'sk-a1a1a1a1a1a1a1a1a',
        "a$1 token = 'a$1\\...efgh'",
        'token = "***REDACTED***" token = "1234...6789"',
        'ghp_...xxsk-' + 'y' * 25,
    ]
    assert apply(spark, texts, text.redact) == shown


def test_code_of_responses(spark):
    fence = "```"
    responses = [
        f"hi\n{fence}py\na = 1\n{fence}\nor\n{fence}\nbbb = 22\nc = 3\n{fence}", "  plain\n\n", "", " \n ", f"{fence}js\n{fence}",
        f"{fence}x y\nnot a tag\n{fence}",
    ]
    code = ["bbb = 22\nc = 3\n", "plain\n", "", "", "\n", f"{fence}x y\nnot a tag\n{fence}\n"]
    assert apply(spark, responses, text.extract_code) == code
