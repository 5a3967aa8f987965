"""Column expressions on text: words, tokens, names, JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: the characters Python's str.split and str.strip treat as space
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# the same set as a pattern; spelt out, since a Unicode class is looked up character by character
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_SPACES}]+"


def words(text: Column) -> Column:
    """White-space separated words; none for blank or null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, SPACE)))


def token_estimate(text: Column) -> Column:
    """int(words x 1.3) in double arithmetic."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("long")


def ignore_case(pattern: str) -> str:
    """Unicode word classes and case-insensitive matching."""
    return f"(?iU){pattern}"


WORD = r"[\p{L}\p{N}_]"
_WORDLY = r"(?:\\d|\\w|\[[0-9A-Za-z-]+\]|(?<!\\)[0-9A-Za-z])"
_STARTS = re.compile(_WORDLY + r"(?!\?|\*|\{0)")
_ENDS = re.compile(_WORDLY + r"(?:\+|\{[1-9]\d*(?:,\d*)?\})?$")


def _starts_with_word(rest: str) -> bool:
    """Whether any match of a pattern's rest begins with a word character, as far as its first atom tells."""
    if not rest.startswith("(?:"):
        return bool(_STARTS.match(rest))
    depth, parts, at = 1, [""], 3
    while at < len(rest) and depth:
        two = rest[at:at + 2] if rest[at] == "\\" else rest[at]
        depth += (two == "(") - (two == ")")
        if two == "|" and depth == 1:
            parts.append("")
        elif depth:
            parts[-1] += two
        at += len(two)
    return not re.match(r"\?|\*|\{0", rest[at:]) and all(_starts_with_word(p) for p in parts)


def _boundary(pattern: str, at: int) -> str:
    """A word boundary at a place of a pattern; one look suffices where a word character stands on one side anyway."""
    if _starts_with_word(pattern[at + 2:]):
        return f"(?<!{WORD})"
    if _ENDS.search(pattern[:at]):
        return f"(?!{WORD})"
    return f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def unicode_pattern(pattern: str, bounded: bool = True) -> str:
    r"""A pattern that ignores case and whose \b, \w, \d and \s go by Unicode letters, numbers and white space.

    A combining mark or a joiner is no word character, so a boundary lies
    between it and a digit; the engine's own Unicode classes see none there.
    Without ``bounded`` word boundaries are left out: a cheaper pattern that is
    found wherever the whole one is.
    """
    classes = {"w": WORD, "d": r"\p{Nd}", "s": "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]"}

    def written(m: re.Match) -> str:
        if m[1] == "b":
            return _boundary(pattern, m.start()) if bounded else ""
        return classes.get(m[1], m[0])

    return "(?iu)" + re.sub(r"\\(.)", written, pattern)


def may_match(text: Column, pattern: str) -> Column:
    """False only for texts without a match; boundaries are not looked at, and signs every match holds are looked for first."""
    found = F.rlike(text, F.lit(unicode_pattern(pattern, bounded=False)))
    outside, before = re.sub(r"\[[^\]]*\]", "", pattern), None  # without character classes and groups
    while outside != before:
        outside, before = re.sub(r"\((?:[^()\\]|\\.)*\)(?:[?*+]|\{[^}]*\})?", "", outside), outside
    if "|" in outside:
        return found
    if re.search(r"@(?![?*{])", outside):
        return F.contains(text, F.lit("@")) & found
    if re.search(r"\\d(?![?*]|\{0)", outside):
        return F.rlike(text, F.lit(r"\p{Nd}")) & found
    return found


def sure_word(pattern: str) -> str:
    """The longest run of letters that every match of a pattern of plain words holds; empty if there is none."""
    plain = re.sub(r"\\.\+?|\([^()]*\)[?*]?|.[?*]", " ", pattern)
    return max(re.findall("[a-z]+", plain), key=len, default="") if "|" not in plain else ""


def matches(text: Column, pattern: str) -> Column:
    return may_match(text, pattern) & F.rlike(text, F.lit(unicode_pattern(pattern)))


def pattern_count(text: Column, pattern: str) -> Column:
    return F.when(may_match(text, pattern), F.regexp_count(text, F.lit(unicode_pattern(pattern)))).otherwise(0)


def strip(text: Column) -> Column:
    """Without white space at either end; looks at the ends only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def title_case(name: Column) -> Column:
    """snake_case to words with capitals."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


# how a display name becomes an identifier: each rule rewrites what the one before left
IDENTIFIER_RULES = [(r"[\s\-]+", "_"), (r"[^a-z0-9_]", ""), (r"^(?=[0-9])", "_")]


def identifier(name: Column, length: int = 63) -> Column:
    """Lower-case table or column name of letters, digits and underscores."""
    out = F.lower(strip(name))
    for pattern, text in IDENTIFIER_RULES:
        out = F.regexp_replace(out, f"(?U){pattern}", text)
    return F.substring(out, 1, length)


def identifier_text(name: str, length: int = 63) -> str:
    """:func:`identifier` for the names of schema fields, by the same rules."""
    out = name.strip().lower()
    for pattern, text in IDENTIFIER_RULES:
        out = re.sub(pattern, text, out)
    return out[:length]


def record_table(org: Column, template: Column) -> Column:
    """Name of the record table of an organisation's template."""
    entity = F.replace(F.replace(F.lower(template), F.lit("_template"), F.lit("")), F.lit("template"), F.lit(""))
    entity = F.regexp_replace(entity, r"^_+|_+$", "")
    return F.concat(identifier(org, 25), F.lit("_"), identifier(entity, 30))


def items_table(org: Column, template: Column) -> Column:
    return F.substring(F.concat(record_table(org, template), F.lit("_line_items")), 1, 63)


def store_name(org: Column) -> Column:
    """Display name of an organisation's search store."""
    safe = F.regexp_replace(F.lower(org), r"[ \-_]+", "_")
    return F.concat(safe, F.lit("_file_search_store"))


def fenced_body(text: Column) -> Column:
    """Inside of the first fenced block, a json fence first; else the text itself."""
    rest_json = F.substring_index(F.substr(text, F.instr(text, "```json") + F.lit(7)), "```", 1)
    rest_any = F.substring_index(F.substr(text, F.instr(text, "```") + F.lit(3)), "```", 1)
    return strip(
        F.when(F.contains(text, F.lit("```json")), rest_json)
        .when(F.contains(text, F.lit("```")), rest_any).otherwise(text)
    )


def is_json_object(text: Column) -> Column:
    """True for a complete JSON object without anything after it; a key may repeat.

    The parser stops at the end of a value, so the text is put into an array and
    into an object: what follows the value breaks one of the two.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    alone = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))) == 1
    return F.coalesce(text.startswith("{") & one & alone, F.lit(False))


def with_json_object(df: DataFrame, body: str, shape: T.StructType, out: str, valid: str) -> DataFrame:
    """``out``: the fields of a complete JSON object in ``body`` without anything after it, and whether it is ``valid``.

    One parse tells both. The text is read as the first of two elements of an
    array, the second being a mark made from the text itself: what follows the
    object ends the array early, adds an element or is no JSON, and in each case
    the mark does not come second. A key may repeat; the last one counts.
    """
    mark, both = "_mark", "_both"
    while mark in shape.names:
        mark = "_" + mark
    while both in df.columns:
        both = "_" + both
    own = F.xxhash64(body).cast("string")
    wrapped = F.concat(F.lit("["), F.col(body), F.lit(f',{{"{mark}":"'), own, F.lit('"}]'))
    element = T.StructType([*shape.fields, T.StructField(mark, T.StringType())])
    rows = df.withColumn(both, F.when(F.startswith(F.col(body), F.lit("{")), F.from_json(wrapped, T.ArrayType(element))))
    marked = F.coalesce((F.size(both) == 2) & (F.get(both, F.lit(1))[mark] == own), F.lit(False))
    # a generator of one row: a filter on either column stays above it, so the text is built and parsed only once
    names = []
    for name in ("_ok", "_value"):
        while name.lower() in {c.lower() for c in df.columns}:
            name = "_" + name
        names.append(name)
    one = F.struct(marked.alias(names[0]), F.when(marked, F.get(both, F.lit(0))).alias(names[1]))
    rows = rows.select("*", F.inline(F.array(one)))
    return rows.withColumn(valid, F.col(names[0])).withColumn(out, F.col(names[1])).drop(both, *names)
