"""Python literals (the text of dicts, lists, tuples, strings, numbers) as JSON.

Some city files hold columns that were written with ``repr()``. A literal is
cut into tokens (strings, numbers, words, brackets, white space), each token
is rewritten on its own, and the tokens are joined to JSON. Text inside a
string is never taken for a word or bracket: its brackets, commas and colons
become ``\\uXXXX`` escapes, so what is left of those in the joined text is
structure, on which tuples, sets, trailing commas and adjacent strings are
settled by plain patterns. What is no token of a literal leaves a mark that
makes the whole text none.

All of it is built-in column functions; ordinary dicts of short strings and
numbers take a short cut, since they are JSON already but for their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

JSON_OPTIONS = {"allowSingleQuotes": "true", "allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}

#: Stand-ins in the text under work: a string's ends, an escaped backslash, what is no literal.
_OPEN, _CLOSE, _SLASH, _BAD = "\x01", "\x02", "\x03", "\x04"

_NUMBER = (r"(?:[+-]\s*)?(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+"
           r"|(?:\d[\d_]*+(?:\.[\d_]*+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?)")
#: possessive loops: a long string costs no stack
_STRING = r"""'(?:[^'\\\n]|\\[\s\S])*+'|"(?:[^"\\\n]|\\[\s\S])*+\""""
_TOKEN = rf"(?:[uUbBrR]?(?:{_STRING}))|{_NUMBER}|[A-Za-z_]\w*+|\s++|[\s\S]"
#: A flat dict whose text is JSON but for single quotes, the three words and
#: ``\\xhh``, without a colon in a string, so that words behind one are words.
_HEX = r"\\x[0-9a-fA-F]{2}"
_SIMPLE = rf"""(?:'[^'\\\n:]*+(?:{_HEX}[^'\\\n:]*+)*+'|"[^"\\\n:]*+(?:{_HEX}[^"\\\n:]*+)*+")"""
_PLAIN_VALUE = rf"(?:{_SIMPLE}|-?(?:0|[1-9]\d{{0,17}})(?:\.\d{{1,17}})?|True|False|None)"
_PLAIN = rf"^\{{(?:{_SIMPLE}: {_PLAIN_VALUE}(?:, (?=['\"])|(?=\}})))*+\}}$"
#: What a literal dict starts with.
_START = r"^\s*[({]"
_STRUCTURE = {"(": "28", ")": "29", "[": "5b", "]": "5d", "{": "7b", "}": "7d", ",": "2c", ":": "3a", '"': "22"}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once and named once: written
    out at each place that needs it, the expression would grow with every step."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def _of_code(piece: Column, digits: str, base: int) -> Column:
    """``piece`` with the digits that it starts with turned into an escape of
    their code unit (up to four hex digits)."""
    return _let(F.regexp_extract(piece, digits, 0), lambda code: F.concat(
        F.lit(r"\u"), F.lpad(F.lower(F.conv(code, base, 16)), 4, "0"),
        F.substring(piece, F.length(code) + 1, F.length(piece))))


def _wide(piece: Column) -> Column:
    """``piece`` whose first eight hex digits name a character."""
    return F.concat(F.decode(F.unhex(F.substring(piece, F.lit(1), F.lit(8))), "UTF-32"),
                    F.substring(piece, F.lit(9), F.length(piece)))


def _each_after(s: Column, cut: str, turn) -> Column:
    """``s`` cut at a pattern, the pieces after a cut turned."""
    return _let(F.split(s, cut), lambda parts: F.concat(F.get(parts, 0), F.array_join(
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: turn(p)), "")))


def _escapes(s: Column) -> Column:
    """Python's escapes as JSON's."""
    s = F.regexp_replace(s, r"\\\n", "")
    s = F.regexp_replace(s, r"""\\(['"])""", "$1")
    s = F.regexp_replace(s, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")
    s = F.regexp_replace(s, r"\\U0000([0-9a-fA-F]{4})", r"\\u$1")
    s = _let(s, lambda v: F.when(F.contains(v, F.lit(r"\U")), _each_after(v, r"\\U", _wide)).otherwise(v))
    s = _let(s, lambda v: F.when(v.rlike(r"\\[0-7]"), _each_after(
        v, r"\\(?=[0-7])", lambda p: _of_code(p, "^[0-7]{1,3}", 8))).otherwise(v))
    s = F.replace(F.replace(s, F.lit(r"\a"), F.lit(r"\u0007")), F.lit(r"\v"), F.lit(r"\u000b"))
    return F.regexp_replace(s, r"\\(?![bfnrt]|u[0-9a-fA-F]{4})", r"\\\\")


def _replaced(s: Column, pairs) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


_WRONG = r"\\x(?![0-9a-fA-F]{2})|\\u(?![0-9a-fA-F]{4})|\\U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|\\N"


def _body(s: Column, raw: Column) -> Column:
    """The inside of a Python string as the inside of a JSON string."""
    marks = [(m, f"\\x{ord(m):02x}") for m in (_OPEN, _CLOSE, _SLASH, _BAD)]
    s = _let(s, lambda v: F.when(v.rlike("[\x01-\x04]"), _replaced(v, marks)).otherwise(v))
    s = _let(s, lambda v: F.when(~F.contains(v, F.lit("\\")), v).when(raw, F.replace(v, F.lit("\\"), F.lit(_SLASH)))
             .otherwise(_let(F.replace(v, F.lit("\\\\"), F.lit(_SLASH)),
                             lambda w: F.when(w.rlike(_WRONG), F.lit(_BAD)).otherwise(_escapes(w)))))
    coded = [(mark, rf"\u00{code}") for mark, code in _STRUCTURE.items()]
    s = _let(s, lambda v: F.when(v.rlike(r'[()\[\]{},:"]'), _replaced(v, coded)).otherwise(v))
    return F.replace(s, F.lit(_SLASH), F.lit(r"\\"))


def _integer(t: Column, base: int) -> Column:
    digits = F.regexp_replace(t, r"^[+-]?\s*0[xXoObB]|_", "")
    return F.concat(F.when(t.startswith("-"), F.lit("-")).otherwise(F.lit("")), F.conv(digits, base, 10))


def _token(t: Column) -> Column:
    """One token of Python as JSON; numbers become strings, as they are."""
    head = F.substring(t, F.lit(1), F.lit(1))
    unspaced = F.regexp_replace(t, r"[\s_]|^\+", "")
    number = (F.when(t.rlike(r"^[+-]?\s*0[xX]"), _integer(t, 16)).when(t.rlike(r"^[+-]?\s*0[oO]"), _integer(t, 8))
              .when(t.rlike(r"^[+-]?\s*0[bB]"), _integer(t, 2))
              .otherwise(_let(unspaced, lambda v: F.when(v.rlike(r"^-?0\d*[1-9]\d*$"), F.lit(_BAD))  # no leading zeros
                              .otherwise(v))))

    def string(prefix: int) -> Column:
        inside = F.substring(t, F.lit(prefix + 2), F.length(t) - prefix - 2)
        return F.concat(F.lit(_OPEN), _body(inside, head.isin("r", "R")), F.lit(_CLOSE))

    # the cheap tests come first: most tokens are brackets, spaces and plain strings
    return (F.when(t.isin(*"[]{}(),: "), F.when(t == " ", F.lit("")).otherwise(t))
            .when(head.isin("'", '"'), F.when(F.length(t) > 1, string(0)).otherwise(F.lit(_BAD)))
            .when(t == "True", F.lit("true")).when(t == "False", F.lit("false")).when(t == "None", F.lit("null"))
            .when(t.rlike("^[uUbBrR]['\"]"), string(1))
            .when(t.rlike(r"^\s"), F.lit(""))
            .when(t.rlike(r"^[+-]?\s*\.?\d"), F.concat(F.lit('"'), number, F.lit('"')))
            .otherwise(F.lit(_BAD)))


def to_json(literal: Column) -> Column:
    """JSON text of a Python literal; null, or text that JSON refuses, if it is
    none."""
    s = F.array_join(F.transform(F.regexp_extract_all(literal, F.lit(_TOKEN), 0), _token), "")
    s = F.replace(s, F.lit(_CLOSE + _OPEN), F.lit(""))  # adjacent strings are one
    s = F.regexp_replace(s, f"[{_OPEN}{_CLOSE}]", '"')
    s = F.regexp_replace(s, r"(?<=[\"\]})a-z]),(?=[\]})])", F.lit("\x05"))  # a comma behind the last element
    s = F.regexp_replace(s, r"(?<=[{,])(true|false|null)(?=:)", '"$1"')
    # brackets around one value without a comma are no tuple
    s = F.regexp_replace(s, r'\(("(?:[^"\\]|\\.)*+"|true|false|null)\)', "$1")
    s = F.regexp_replace(s, r"(?s)^\((\{.*\})\)$", "$1")
    s = F.regexp_replace(s, r"\{([^{}:]+)\}", "[$1]")  # a set
    return _let(s, lambda v: F.when(~F.contains(v, F.lit(_BAD)), F.translate(v, "()\x05", "[]")))


def parsed(literal: Column, fields: T.StructType) -> Column:
    """The fields of a literal dict as a struct of strings; null if the text is
    no literal or no dict."""
    word = literal
    for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
        word = F.replace(word, F.lit(f": {python}"), F.lit(f": {json}"))
    word = F.replace(word, F.lit(r"\x"), F.lit(r"\u00"))  # a plain dict has no other backslash
    plain = F.from_json(word, fields, JSON_OPTIONS)
    # an array around it: text behind the dict is an error, and other things than one dict are seen
    other = F.from_json(F.concat(F.lit("["), to_json(literal), F.lit("]")), T.ArrayType(fields), JSON_OPTIONS)
    single = _let(other, lambda v: F.when(F.size(v) == 1, F.get(v, 0)))
    return F.when(literal.rlike(_PLAIN), plain).when(literal.rlike(_START), single)
