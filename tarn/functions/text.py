"""Text, date, number and identifier functions as column expressions (JVM side)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Characters of the Latin, Greek and Cyrillic blocks that decompose to one base character with marks, and their bases; derived from the
    Unicode data by rule."""
    source, target = [], []
    for code in [*range(0x00A0, 0x0250), *range(0x0370, 0x0530), *range(0x1E00, 0x2000)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def fold(x) -> Column:
    """Without diacritics. Ligatures and compatibility forms that decompose to several characters stay; see exact_fold."""
    source, target = _folding()
    return F.regexp_replace(F.translate(_col(x), source, target), r"\p{M}+", "")


def normalize_name(x, strip_marker: bool = True) -> Column:
    """Lower case, no diacritics, single spaces, and no trailing asterisk (strip_marker); null and blank give ''."""
    out = fold(x)
    if strip_marker:
        out = F.regexp_replace(out, r"(?U)\s*\*\s*$", "")
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")), F.lit(""))


def exact_fold(x) -> Column:
    """fold by full compatibility decomposition, in Arrow batches; for texts beyond the blocks that fold covers."""

    @F.pandas_udf("string")
    def decomposed(s):
        return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))

    return decomposed(_col(x))


def clean_name(x) -> Column:
    """A name without a trailing captain's mark (' – C', '- A')."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)\s*[–-]\s*[CA]\b\s*$", ""))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def birth_date(x) -> Column:
    """Struct (iso, year) of YYYY-M-D or D.M.YYYY, nulls otherwise; the calendar isn't checked."""
    s = F.trim(_col(x))
    year_first, day_first = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
    part = lambda p, i: F.regexp_extract(s, p, i)
    iso = F.when(s.rlike(year_first), _iso(*(part(year_first, i) for i in (1, 2, 3)))).when(s.rlike(day_first), _iso(*(part(day_first, i) for i in (3, 2, 1))))
    return F.struct(iso.alias("iso"), F.substring(iso, 1, 4).cast("int").alias("year"))


def date_in_parentheses(x) -> Column:
    """Struct (iso, year) of the first ISO date in parentheses."""
    pattern = r"\(\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*\)"
    iso = F.when(_col(x).rlike(pattern), _iso(*(F.regexp_extract(_col(x), pattern, i) for i in (1, 2, 3))))
    return F.struct(iso.alias("iso"), F.substring(iso, 1, 4).cast("int").alias("year"))


def number(x) -> Column:
    """Decimal comma to point, everything but digits, points and minus signs dropped; no number gives null."""
    s = F.regexp_replace(F.replace(_col(x), F.lit(","), F.lit(".")), r"[^0-9.\-]", "")
    return F.nullif(s, F.lit("")).try_cast("double")


def clean(x) -> Column:
    """Without no-break spaces and outer white space; nothing left gives null."""
    return F.nullif(F.btrim(F.replace(_col(x), F.lit(" "), F.lit("")), F.lit(" \t\r\n")), F.lit(""))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_name(x, strip_marker=False), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def full_name(first, last) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(_col(first), F.lit("")), F.coalesce(_col(last), F.lit(""))))


def name_parts(x) -> Column:
    """Struct (first, last): the first word, and the others."""
    words = F.filter(F.split(_col(x), r"(?U)\s+"), lambda w: w != "")
    return F.struct(F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("first"), F.array_join(F.slice(words, 2, 1000), " ").alias("last"))


def localized(x: str, language: str) -> Column:
    """Field `language` of a struct column of texts, its `default` where that is missing or empty."""
    return F.coalesce(F.nullif(F.col(f"{x}.{language}"), F.lit("")), F.nullif(F.col(f"{x}.default"), F.lit("")))


def season_start(x) -> Column:
    """2024 of '2024-25', '20242025' or 2024."""
    return F.substring(_col(x).cast("string"), 1, 4).try_cast("int")


def season_id(start) -> Column:
    """'20242025' of 2024."""
    return F.concat(_col(start).cast("string"), (_col(start) + 1).cast("string"))


def person_id(source: str, x) -> Column:
    return F.concat(F.lit(f"{source}-"), _col(x).cast("string"))


def url(prefix: str, x, suffix: str = "") -> Column:
    """An address with an id in it; a null id gives null."""
    return F.concat(F.lit(prefix), _col(x).cast("string"), F.lit(suffix))


def round_half_even(x, places: int) -> Column:
    """Rounding of decimals as the decimal text of a double has it, halves to even."""
    return F.bround(_col(x), places)


def round_binary(x, places: int = 2) -> Column:
    """Rounding of the binary value that a double is, halves to even: 2.675 is below its decimal text and gives 2.67. In Arrow batches; for report tables."""

    @F.arrow_udf("double")
    def rounded(v):
        return pa.array([None if i is None else round(i, places) for i in v.to_pylist()], pa.float64())

    return rounded(_col(x).cast("double"))


def signed(x, places: int = 2) -> Column:
    """A number with sign and decimal comma, rounded as the binary value that a double is, halves to even; null of null, and a zero has a plus. In Arrow batches."""

    @F.arrow_udf("string")
    def formatted(v):
        return pa.array([None if i is None else f"{i + 0.0:+.{places}f}".replace(".", ",") for i in v.to_pylist()], pa.string())

    return formatted(_col(x).cast("double"))


def without_tags(x) -> Column:
    return F.trim(F.regexp_replace(_col(x), "<[^>]+>", ""))


def excerpt(x, most: int = 320) -> Column:
    """At most `most` characters, cut at the last space before, with an ellipsis where something was cut."""
    s, head = _col(x), F.substring(_col(x), 1, most)
    words = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(s) > most, F.concat(words, F.lit("…"))).otherwise(s)


def bold(x) -> Column:
    return F.regexp_replace(_col(x), r"(?s)\*\*(.+?)\*\*", "<strong>$1</strong>")


def paragraphs(x) -> Column:
    """Paragraphs, separated by empty lines, in <p> elements a line."""
    each = F.filter(F.transform(F.split(bold(x), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.transform(each, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")


def brief(x) -> Column:
    """Struct (title, meta, sections: array of (heading, html)) of a Markdown text, read line by line: a code fence around all of it goes; a first line with
    one # is the title, what it has in parentheses at its end the meta; a line with two # opens a section; other lines belong to the open one, which
    has no heading before the first. Empty sections go."""
    every = F.split(F.trim(_col(x)), "\n")
    fenced, last = F.get(every, F.lit(0)).startswith("```"), F.size(every) - 1
    lines = F.when(fenced, F.filter(every, lambda v, i: (i > 0) & ~((i == last) & (F.rtrim(v) == "```")))).otherwise(every)
    top = F.get(lines, F.lit(0))
    head = F.when(top.startswith("# ") & (F.size(lines) > 1), F.trim(F.substring(top, F.lit(2), F.length(top)))).otherwise(F.lit(""))
    opens = F.length(F.substring_index(head, "(", -1))
    meta = F.when(head.endswith(")") & (F.instr(head, "(") > 0), F.substring(head, F.length(head) - opens + 1, opens - 1)).otherwise(F.lit(""))
    title = F.when(meta != "", F.rtrim(F.substring(head, F.lit(1), F.length(head) - opens - 1))).otherwise(head)
    body = F.filter(lines, lambda _, i: (head == "") | (i > 0))
    section = lambda heading, text: F.struct(heading.alias("heading"), text.alias("body"))

    def step(done, line):
        open_ = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(section(open_["heading"], F.concat(open_["body"], F.lit("\n"), line))))
        return F.when(line.startswith("## "), F.concat(done, F.array(section(F.trim(F.substring(line, F.lit(3), F.length(line))), F.lit(""))))).otherwise(longer)

    made = F.aggregate(body, F.array(section(F.lit(""), F.lit(""))), step)
    kept = F.filter(made, lambda c: (c["heading"] != "") | (F.btrim(c["body"], F.lit(" \n")) != ""))
    return F.struct(title.alias("title"), meta.alias("meta"), F.transform(kept, lambda c: F.struct(c["heading"].alias("heading"), paragraphs(F.btrim(c["body"], F.lit("\n"))).alias("html"))).alias("sections"))
