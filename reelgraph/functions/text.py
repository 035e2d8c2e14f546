"""Scalar text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of four letters or more that carry no content, for warrants, for citation checks and for contexts.
WARRANT_STOP = [
    "what", "when", "where", "which", "this", "that", "with", "from", "have", "does", "into", "about", "type", "last", "first", "video", "they", "their",
    "would", "could", "there", "after", "before", "during", "while",
]
CITATION_STOP = ["what", "when", "where", "which", "this", "that", "with", "from", "have", "does", "into", "about", "type", "last", "first", "video", "they", "their"]
CONTEXT_STOP = ["what", "when", "where", "which", "this", "that", "with", "from", "have", "does", "into", "about", "type", "last", "first", "video"]
KEYWORD = r"[\p{L}\p{N}_]{4,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(text) -> Column:
    """``S``, ``M:S`` or ``H:M:S`` in seconds; minutes may exceed 59; null if it does not parse."""
    parts = F.split(F.trim(_col(text)), ":")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 1, number(1)).when(F.size(parts) == 2, number(1) * 60 + number(2)).when(F.size(parts) == 3, number(1) * 3600 + number(2) * 60 + number(3))


def time_range(text) -> Column:
    """Struct (t0, t1) of a time reference; two, three or four parts between hyphens; null if none parses.

    Three parts are tried as (first and second joined, third), then as (first, second and third joined).
    """
    p = F.split(F.trim(_col(text)), "-")
    n = F.size(p)
    # candidates as (first, second); bound by a lambda, so that each is parsed once
    joined = lambda *at: F.array_join(F.transform(F.array(*[F.try_element_at(p, F.lit(i)) for i in at]), lambda x: F.trim(x)), ":")
    pair = lambda a, b: F.array(joined(*a), joined(*b))
    tries = F.when(n == 2, F.array(pair((1,), (2,)))).when(n == 3, F.array(pair((1, 2), (3,)), pair((1,), (2, 3)))).when(n == 4, F.array(pair((1, 2), (3, 4))))
    parsed = F.transform(tries, lambda x: F.transform(x, seconds))
    first = F.try_element_at(F.filter(parsed, lambda x: x[0].isNotNull() & x[1].isNotNull()), F.lit(1))
    return F.when(first.isNotNull(), F.struct(F.array_min(first).alias("t0"), F.array_max(first).alias("t1")))


def cue_seconds(text) -> Column:
    """``H:MM:SS,fff`` or with a point; the fraction is padded to milliseconds on the right."""
    pattern = r"(\d{1,2}):(\d{2}):(\d{2})[.,](\d{1,3})"
    g = lambda i: F.regexp_extract(_col(text), pattern, i)
    return F.when(_col(text).rlike(pattern), g(1).try_cast("double") * 3600 + g(2).try_cast("double") * 60 + g(3).try_cast("double") + F.rpad(g(4), 3, "0").try_cast("double") / 1000)


def clean_caption(text) -> Column:
    """Without ``<…>`` and ``{…}``, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"<[^>]*>|\{[^}]*\}", ""), r"\s+", " "))


def list_literal(text) -> Column:
    """Array of the items of ``"['a', 'b']"``."""
    return F.filter(F.transform(F.split(F.regexp_replace(_col(text), r"[\[\]'\"]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")


def options(text) -> Column:
    """Map from letter to text of ``(A) … (B) …``."""
    pattern = F.lit(r"\(([A-D])\)\s*([^()]*?)(?=\s*\([A-D]\)|$)")
    return F.map_from_arrays(F.regexp_extract_all(_col(text), pattern, F.lit(1)), F.transform(F.regexp_extract_all(_col(text), pattern, F.lit(2)), lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")))


def answer_letter(text) -> Column:
    """The first line that is a letter A to D alone, else the last letter that stands alone, else ''."""
    said = F.regexp_replace(_col(text), r"(?s)<think>.*?</think>", "")
    alone = F.filter(F.transform(F.split(said, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[A-D]$"))
    standing = F.regexp_extract_all(said, F.lit(r"\b([A-D])\b"), F.lit(1))
    return F.coalesce(F.try_element_at(alone, F.lit(1)), F.try_element_at(standing, F.lit(-1)), F.lit(""))


def question_type(text, fold: bool = True) -> Column:
    out = F.regexp_replace(F.trim(_col(text)), r"^['\[\]]+|['\[\]]+$", "")
    return F.lower(out) if fold else out


def words(text, least: int = 4) -> Column:
    """Distinct lower-cased words of at least so many characters, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(text)), r"\s+"), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint > 0, F.size(F.array_intersect(a, b)) / joint).otherwise(F.lit(0.0))


def keywords(text, stop: list[str] = WARRANT_STOP) -> Column:
    """Distinct words of four or more letters, digits or underscores, without stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(KEYWORD), F.lit(0))), F.array(*map(F.lit, stop)))


def keyword_hits(wanted: Column, text) -> Column:
    """How many of the keywords stand in a text, as substrings."""
    t = F.lower(_col(text))
    return F.size(F.filter(wanted, lambda w: F.contains(t, w)))


def keyword_score(wanted: Column, text) -> Column:
    n = F.size(wanted)
    return F.when((n > 0) & (keyword_hits(wanted, text) > 0), 0.5 + 0.4 * keyword_hits(wanted, text) / n)


def either_contains(a, b) -> Column:
    """Either text, lower-cased, stands in the other; an empty one matches nothing."""
    x, y = F.lower(F.trim(_col(a))), F.lower(F.trim(_col(b)))
    return (F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x))


def location_key(text) -> Column:
    return F.regexp_replace(F.trim(F.lower(_col(text))), "s+$", "")


def banner_name(text) -> Column:
    """Is a text without digits, in title case, one to three capitalised words?"""
    word = r"\p{Lu}[\p{L}'’\-]{1,15}"
    title = F.initcap(F.lower(_col(text)))
    return ~_col(text).rlike(r"\d") & title.rlike(rf"^{word}( {word}){{0,2}}$")


def object_description(label, attributes, state) -> Column:
    return F.concat_ws(" ", _col(label), F.array_join(_col(attributes), " "), _col(state))


def node_text(node_type="node_type", label="label", description="canonical_description", prev="prev_state", to="next_state", t="t_start") -> Column:
    """What is embedded of a node, by its type."""
    kind, at = _col(node_type), F.format_string("%.0f", _col(t))
    text = F.coalesce(_col(label), F.lit(""))
    return (
        F.when(kind == "CharacterNode", F.concat(F.lit("Character: "), F.coalesce(_col(description), text)))
        .when(kind == "StateChangeNode", F.concat(F.lit("State change: "), text, F.lit(" from "), F.coalesce(_col(prev), F.lit("")), F.lit(" to "), F.coalesce(_col(to), F.lit(""))))
        .when(kind == "SpeechNode", F.concat(F.lit("Speech at "), at, F.lit("s: "), text))
        .when(kind == "OCRNode", F.concat(F.lit("On-screen text: "), text))
        .when(kind == "AudioEventNode", F.concat(F.lit("Audio event at "), at, F.lit("s")))
        .otherwise(F.concat(F.regexp_replace(kind, "Node$", ""), F.lit(": "), text))
    )


def episode_label(label, role, summary) -> Column:
    """A generic label gives way to the role and the start of the summary."""
    generic = _col(label).rlike(r"^Episode \d+$") & (F.length(F.coalesce(_col(summary), F.lit(""))) > 0)
    return F.when(generic, F.concat(F.initcap(F.coalesce(_col(role), F.lit(""))), F.lit(": "), F.left(_col(summary), F.lit(50)))).otherwise(_col(label))


def balanced_object(text: str | None) -> str | None:
    """The first balanced ``{…}`` of a text, strings respected; for a Python UDF."""
    if text is None:
        return None
    depth = begin = 0
    quoted = escaped = False
    for i, c in enumerate(text):
        if depth and quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"' and depth:
            quoted, escaped = True, False
        elif c == "{":
            begin, depth = (i if not depth else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None


def first_object(text) -> Column:
    """The first balanced object behind any thinking; brace counting is beyond regular expressions."""
    @F.pandas_udf("string")
    def pick(s: pd.Series) -> pd.Series:
        return s.map(balanced_object)

    return pick(F.regexp_replace(_col(text), r"(?s)<think>.*?</think>", ""))


def tool_calls(text) -> Column:
    """Array of (name, args) of ``<tool name="…"><param name="…">…</param></tool>`` blocks and ``<function=…>`` forms."""
    call = re.compile(r"<function=([\w.-]+)>(.*?)</function>", re.S)
    param = re.compile(r"<parameter=([\w.-]+)>(.*?)</parameter>", re.S)

    @F.pandas_udf("array<struct<name:string,args:map<string,string>>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"name": n, "args": {k: v.strip() for k, v in param.findall(body)}} for n, body in call.findall(t or "")])

    return parse(_col(text))


def react_action(text) -> Column:
    """Struct (name, args) of the last ``Action: name(args)``."""
    pattern = F.lit(r"Action:\s*(\w+)\((.*?)\)")
    name = F.try_element_at(F.regexp_extract_all(_col(text), pattern, F.lit(1)), F.lit(-1))
    args = F.try_element_at(F.regexp_extract_all(_col(text), pattern, F.lit(2)), F.lit(-1))
    return F.when(name.isNotNull(), F.struct(name.alias("name"), F.transform(F.split(args, ","), lambda a: F.regexp_replace(F.trim(a), r"^['\"]|['\"]$", "")).alias("args")))
