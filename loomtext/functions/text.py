"""Text functions and predicates as Column expressions (all inside the JVM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNTRANSLATED

WORDS = r"\S+"
#: The beginning of a text of ten words or more.
TEN_WORDS = r"^\S+(?:\s+\S+){9}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once for each row, however often f uses it and wherever the optimizer copies the result."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def count(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(x), F.lit(pattern))


def count_chars(x: Column | str, others: str) -> Column:
    """Characters outside the class `others`: what is left without its runs. (An array of all matches, as regexp_count makes, costs many times that.)"""
    return F.length(F.regexp_replace(_c(x), others + "+", ""))


#: The characters of \s.
SPACES = " \t\n\x0b\f\r"


def trim_ws(x: Column | str) -> Column:
    return F.btrim(_c(x), F.lit(SPACES))


def normalize(x: Column | str) -> Column:
    """Lower case, single spaces, no outer white space. (Single spaces are left alone: most texts hold nothing to replace.)"""
    return F.regexp_replace(trim_ws(F.lower(_c(x))), r"[\t\n\x0B\f\r]\s*| \s+", " ")


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(WORDS), F.lit(0))


def n_words(x: Column | str) -> Column:
    return count(x, WORDS)


def blank(x: Column | str) -> Column:
    return F.coalesce(trim_ws(x), F.lit("")) == ""


def is_translatable(block_type: Column | str) -> Column:
    return ~_c(block_type).isin(UNTRANSLATED)


def skip_reason(block_type: Column | str, text: Column | str, tables: bool = False, figures: bool = False) -> Column:
    """Why a block isn't sent to translation; null if it is."""
    kind = _c(block_type)
    return (
        F.when(~is_translatable(kind), "non_translatable_content")
        .when((kind == "TABLE") & F.lit(not tables) & blank(text), "table_policy")
        .when((kind == "FIGURE") & F.lit(not figures) & blank(text), "figure_policy")
    )


def layout_type(x: Column | str) -> Column:
    """Block type by the first rule that fits."""
    kind = lambda t: (
        F.when((F.length(t) < 100) & t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}"), "TITLE")
        .when(F.startswith(F.lower(t), F.lit("abstract")), "ABSTRACT")
        .when(~t.rlike(TEN_WORDS) & ~F.endswith(t, F.lit(".")), "HEADING")
        .when(F.contains(t, F.lit("$")) | F.contains(t, F.lit("\\")), "EQUATION")
        .when(t.rlike(r"^([•*–-]|\d+\.)"), "LIST_ITEM")
        .otherwise("PARAGRAPH")
    )
    return once(trim_ws(x), kind)


def style_type(font_flags: dict[str, Column]) -> Column:
    """Block type from style flags, in order of precedence; PARAGRAPH if none is set. heading_level picks HEADING or SUBHEADING."""
    level = font_flags.get("heading_level", F.lit(None).cast("int"))
    out = F.when(level == 1, "HEADING").when(level.isNotNull(), "SUBHEADING")
    #: Flags in order of precedence.
    for flag, kind in (("is_list", "LIST_ITEM"), ("is_caption", "CAPTION"), ("is_footer", "FOOTER"), ("is_header", "HEADER"), ("is_abstract", "ABSTRACT"), ("is_reference", "REFERENCE"), ("is_footnote", "FOOTNOTE"), ("is_code", "CODE"), ("is_equation", "EQUATION")):
        if flag in font_flags:
            out = out.when(font_flags[flag], kind)
    return out.otherwise("PARAGRAPH")


def letters(x: Column | str) -> Column:
    return count_chars(x, r"\P{L}")


def has_letters(x: Column | str, least: float = 0.3) -> Column:
    n = F.length(trim_ws(x))
    return F.coalesce((n > 0) & (letters(x) / F.when(n > 0, n) >= least), F.lit(False))


PLACEHOLDER = r"<<[A-Z_]+_\d+>>|MASK_[A-Z_]+_\d+_MASK"


def placeholder_chars(x: Column | str) -> Column:
    return F.length(_c(x)) - F.length(F.regexp_replace(_c(x), PLACEHOLDER, ""))


def identity_failure(source: Column | str, target: Column | str, same_language: Column | None = None) -> Column:
    """Long prose that came back unchanged: not headings, acronyms, numbers or placeholders."""
    s, n = _c(source), F.length(_c(source))
    upper, alpha = count_chars(s, r"\P{Lu}"), letters(s)
    prose = (F.length(trim_ws(s)) >= 30) & (n_words(s) >= 6) & (10 * upper <= 7 * alpha) & (10 * count_chars(s, r"\P{Nd}") <= 3 * n) & (2 * placeholder_chars(s) <= n)
    other = ~(F.lit(False) if same_language is None else same_language)
    return F.coalesce(F.when(other & (normalize(s) == normalize(target)), prose), F.lit(False))  # a branch: counted for equal texts only


def simple_identity(source: Column | str, target: Column | str) -> Column:
    """The coverage detector's shorter test."""
    same = lambda s: F.when(s == normalize(target), has_letters(s) & (F.length(s) >= 5) & (letters(s) >= 0.4 * F.length(s)))
    return F.coalesce(once(normalize(source), same), F.lit(False))


def truncated(source: Column | str, target: Column | str, finish_reason: Column | None = None, cjk: Column | None = None) -> Column:
    finish_reason = F.lit(None).cast("string") if finish_reason is None else finish_reason
    cjk = F.lit(False) if cjk is None else cjk
    s, t = F.length(_c(source)), F.length(_c(target))
    end = F.regexp_replace(_c(target), r"\s+$", "")
    hit = finish_reason.isin("length", "max_tokens", "truncated")
    short = ~cjk & (s > 300) & (t < 0.15 * s)
    cut = (s > 200) & (t < 0.4 * s) & (end != "") & ~end.rlike("[.!?。！？]$")
    return F.coalesce((s > 0) & (t > 0) & (F.coalesce(hit, F.lit(False)) | short | cut), F.lit(False))


def has_wrapper(x: Column | str) -> Column:
    return _c(x).rlike(r"(?i)<think>|<thinking>|^Translation:|^```")


def clean_output(x: Column | str) -> Column:
    """A model's answer without reasoning, code fence, lead-in and quotes; the answer itself where nothing would stay."""
    t = F.regexp_replace(_c(x), r"(?is)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?is)<thinking>.*?</thinking>", "")
    fenced = F.regexp_extract(trim_ws(t), r"(?s)^```(?:\w+)?\s*\n(.*?)\n```\s*$", 1)
    t = F.when(trim_ws(t).rlike(r"(?s)^```(?:\w+)?\s*\n(.*?)\n```\s*$"), fenced).otherwise(t)
    for lead in ("Translation", "Translated text", "Output", "Result"):
        t = F.regexp_replace(t, rf"(?i)^{lead}:\s*", "")
    t = F.regexp_replace(trim_ws(t), r"(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")
    t = trim_ws(t)
    return F.when(t == "", _c(x)).otherwise(t)


def strip_control(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"\p{C}", "")


def postprocess(x: Column | str, glossary=lambda c: c) -> Column:
    """A translation's final clean-up; `glossary` rewrites terms between the control characters and the spaces."""
    t = trim_ws(_c(x))
    t = F.regexp_replace(t, r"(?s)^<think>.*?</think>\s*", "")
    t = F.translate(t, "\u00a0\u2018\u2019`\u00b4\ufffd", " '''''")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, r"[\p{C}&&[^\n]]", "")
    t = glossary(t)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m) +$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r" +([.,;:!?])", "$1")


def reflow(x: Column | str) -> Column:
    """Single line breaks become spaces; paragraphs stay."""
    return F.array_join(F.transform(F.split(_c(x), "\n\n"), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))), "\n\n")


def preview(x: Column | str, n: int = 100) -> Column:
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit("..."))).otherwise(_c(x))


def content_hash(x: Column | str) -> Column:
    return F.md5(_c(x))


def short_hash(x: Column | str) -> Column:
    return F.substring(F.md5(_c(x)), 1, 8)


NUMBER = r"[+-]?\d+(?:[.,]\d+)?"


def numbers(x: Column | str) -> Column:
    """Distinct numbers, comma as point."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda n: F.translate(n, ", ", ".")))


def rgb(x: Column | str) -> Column:
    """#rrggbb as shares of 1."""
    h = F.regexp_replace(_c(x), "^#", "")
    part = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("double") / 255
    return F.when(h.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5)))


def base_font(family: Column | str, weight: Column | str, style: Column | str) -> Column:
    """One of the fourteen standard fonts by name, weight and style."""
    f, bold = F.lower(_c(family)), F.lower(_c(weight)).rlike("bold|black|heavy|[6-9]00") | F.lower(_c(family)).contains("bold")
    slant = F.lower(_c(style)).rlike("italic|oblique") | F.lower(_c(family)).rlike("italic|oblique")
    kind = F.when(f.rlike("mono|courier|consol|typewriter"), "cour").when(f.rlike("times|serif|roman|georgia|garamond|cmr") & ~f.contains("sans"), "times").otherwise("helv")
    tail = F.when(bold & slant, "bi").when(bold, "bo").when(slant, "it").otherwise("")
    return F.concat(kind, tail)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 where they don't meet or have no area."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when((w > 0) & (h > 0) & (both > 0), w * h / both).otherwise(F.lit(0.0))


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes that share at least an edge."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def inside(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])
