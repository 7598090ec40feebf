"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_code_fences(c: Column) -> Column:
    """Text without a leading ```python, ```py or bare fence and a trailing one; NULL becomes ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    c = F.regexp_replace(c, r"^```(python|py)?[ \t]*\n?", "")
    return F.regexp_replace(F.regexp_replace(c, r"\n?```$", ""), r"^\s+|\s+$", "")


def python_literals(c: Column) -> Column:
    """JSON's true, false and null as whole words in Python's spelling."""
    for a, b in (("true", "True"), ("false", "False"), ("null", "None")):
        c = F.regexp_replace(c, rf"\b{a}\b", b)
    return c


#: Characters that LaTeX reserves and their escapes; the backslash goes first, by a mark of its own.
LATEX = [("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]
MARK = "\u0001"


def latex_escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit(MARK))
    for a, b in LATEX:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit(MARK), F.lit(r"\textbackslash{}"))


#: What a report's text keeps, beside letters, numbers, punctuation and blanks of any script.
PRINTABLE = r"\x00-\x7E\x{80}-\x{FF}\x{2000}-\x{206F}\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}"


def strip_emoji(c: Column) -> Column:
    """Text without emoji and other symbols."""
    return F.regexp_replace(c, rf"[^{PRINTABLE}\p{{L}}\p{{N}}\p{{P}}\p{{Z}}]", "")


def format_optional(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def token_estimate(c: Column) -> Column:
    """Length / 4, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def chunks(c: str, size: int = 800, stride: int = 600) -> Column:
    """Array of (chunk_no, chunk): overlapping windows of a text; none for an empty one."""
    return F.expr(f"if(length({c}) > 0, transform(sequence(0, length({c}) - 1, {stride}), (s, i) -> struct(i as chunk_no, substring({c}, s + 1, {size}) as chunk)), array())")


def label_list(c: str) -> Column:
    """Comma-separated whole numbers; what isn't one becomes NULL."""
    return F.expr(f"transform(split({c}, ','), x -> try_cast(trim(x) as int))")


def best_json(c: str) -> Column:
    """The first of: the text, its fenced part, its part between outermost braces, that parses as JSON; else '{}'."""
    fenced = f"regexp_extract({c}, '(?s)```(?:json)?[ \\\\t]*\\\\n?(.*?)```', 1)"
    braces = f"regexp_extract({c}, '(?s)[{{].*[}}]', 0)"
    bare = lambda e: f"regexp_replace({e}, '^\\\\s+|\\\\s+$', '')"
    ok = lambda e: f"if(try_parse_json(nullif({bare(e)}, '')) is not null, {bare(e)}, null)"
    return F.expr(f"coalesce({ok(c)}, {ok(fenced)}, {ok(braces)}, '{{}}')")


def tumour_barcode(c: str) -> Column:
    """True unless the fourth '-' part starts with a two-digit number of 10 or more (normal tissue)."""
    return F.expr(f"coalesce(try_cast(substr(get(split({c}, '-'), 3), 1, 2) as int) < 10, true) or size(split({c}, '-')) < 4 or length(get(split({c}, '-'), 3)) < 2")


#: Canonical names of subtype labels.
SUBTYPES = {"luma": "LumA", "lumb": "LumB", "her2": "Her2", "basal": "Basal", "normal": "Normal"}


def canonical_label(c: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUBTYPES.items() for x in kv]), F.lower(F.trim(F.col(c))))
