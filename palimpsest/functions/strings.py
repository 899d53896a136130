"""Column functions on text that several operators share."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def found(c: Column, pattern: str, group: int = 0, shape: str | None = None) -> Column:
    """All matches in order. ``shape``: a cheaper pattern, that finds something in each text with a match."""
    matches = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return matches if shape is None else F.when(~F.rlike(c, F.lit(shape)), F.array().cast("array<string>")).otherwise(matches)


def lines(c: Column) -> Column:
    """Lines at every kind of line break; a final break starts no further line."""
    parts = F.split(F.regexp_replace(c, fixed.LINE_BREAK, "\n"), "\n")
    return F.when(c == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def mapped(c: Column, values: dict[str, str]) -> Column:
    """Fixed replacements of whole values; others stay."""
    return reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), reversed(values.items()), c)


def replaced_each(c: Column, pattern: str, make, shape: str | None = None) -> Column:
    """Every match m (number i, from 0) becomes make(m, i): the pieces between matches and the new texts are joined again. ``shape``: see ``found``."""
    pieces, matches = F.split(c, pattern, -1), found(c, pattern, 0, shape)
    joined = F.transform(pieces, lambda piece, i: F.concat(piece, F.coalesce(make(F.get(matches, i), i), F.lit(""))))
    return F.when(F.size(matches) == 0, c).otherwise(F.array_join(joined, ""))


def literal(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded(s: str) -> str:
    """Case folded character by character, as matching without case compares them; lengths stay."""
    one = lambda c, d: d if len(d) == 1 else c
    return "".join(one(c, one(c, c.upper()).lower()) for c in s)


def required(pattern: str) -> str:
    """The longest literal that every match of a pattern holds, case folded; empty if there is none to be sure of."""
    if pattern.startswith(r"\Q") and pattern.endswith(r"\E"):
        return folded(pattern[2:-2])
    try:
        parts = re._parser.parse(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern))
    except re.error:
        return ""
    runs, run = [], ""
    for op, value in parts:
        if op is re._constants.LITERAL:
            run += chr(value)
        else:
            runs, run = [*runs, run], ""
    return folded(max([*runs, run], key=len))


def begun(pattern: str, first: str) -> str:
    """A pattern that is tried only where one of some characters stands, which each of its matches begins with: cheaper than a look at the border of a word at every place."""
    flags = re.match(r"(\(\?[a-zA-Z]+\))?", pattern)[0]
    return f"{flags}(?=(?-iU:[{first}]))(?:{pattern[len(flags):]})"


def _tried(pattern: str) -> str:
    """A pattern without case as ``begun``, if it begins with a letter."""
    try:
        parts = [part for part in re._parser.parse(pattern.removeprefix("(?iU)")) if part[0] != re._constants.AT]
    except re.error:
        return pattern
    if not pattern.startswith("(?iU)") or not parts or parts[0][0] != re._constants.LITERAL or not (c := chr(parts[0][1]).lower()).isascii() or not c.isalpha():
        return pattern
    return begun(pattern, c + c.upper() + "".join(odd for odd, plain in zip(*_ODD_CASES, strict=True) if plain == c))


#: Characters beyond ASCII that match an ASCII letter without case, and these letters.
_ODD_CASES = ("\u017f\u212a\u0130\u0131", "skii")


def _low(c: str) -> str:
    """SQL of a text whose ASCII letters are all that match without case, in lower case."""
    return f"lower(translate({c}, '{_ODD_CASES[0]}', '{_ODD_CASES[1]}'))"


def chained(c: str | Column, rules) -> Column:
    """Sequential replacements (pattern, replacement). A column's name gives one SQL text, which is built at once and not call by call.

    With a name, a rule runs only where the text, as the rules before have left it, holds the literal that each of its
    matches needs. Rules without such a literal always run.
    """
    if not isinstance(c, str):
        return reduce(lambda out, rule: F.regexp_replace(out, rule[0], rule[1]), rules, c)
    rules = [(_tried(pattern), new, need if len(need := required(pattern)) > 1 and need.isascii() else "") for pattern, new in rules]
    out = f"`{c}`"
    for guarded, some in groupby(rules, lambda rule: bool(rule[2])):
        some = list(some)
        if not guarded or len(some) < 3:
            out = reduce(lambda o, rule: f"regexp_replace({o}, {literal(rule[0])}, {literal(rule[1])})", some, out)
            continue
        table = ", ".join(f"named_struct('need', {literal(r[2])}, 'pattern', {literal(r[0])}, 'new', {literal(r[1])})" for r in some)
        state = lambda x: f"named_struct('now', {x}, 'low', {_low(x)})"
        done = f"get(transform(array(regexp_replace(s.now, r.pattern, r.new)), x -> {state('x')}), 0)"
        out = f"aggregate(array({table}), get(transform(array({out}), x -> {state('x')}), 0), (s, r) -> if(contains(s.low, r.need), {done}, s), s -> s.now)"
    return F.expr(out)
