"""Extraction from HTML pages. Fields with a marked element are read by JVM-side patterns; tables by a parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tarn.functions.text import clean, clean_name, date_in_parentheses, normalize_name


#: Fixed values of the pages: headers of standings and of statistics, the totals row, links of clubs and persons, headings and headers of squads.
STANDINGS, STATISTICS, TOTAL = ("Tým", "Z", "V", "P", "Skóre", "B"), ("GP", "G", "A", "P", "PIM"), "Yht."
PERSON_HEADER, TEAM_HEADER, POSITION_HEADER = "JMÉNO", "TÝM", "POZ."
CLUB_LINK, PERSON_LINK = r"^/klub/([a-z0-9-]+)/(\d+)", r"^/hrac/([a-z0-9-]+)/(\d+)"
COUNTRY_HEADINGS = ("Czechia", "Czech Republic", "Česko", "Česká republika")
NAMES, BIRTHDATES, CLUBS, SQUAD_POSITION = ("Name", "Player"), ("Birthdate", "Date of birth"), ("Team", "Club"), "Pos."


def text_of(x: Column) -> Column:
    """Text of an HTML fragment: tags out, the commonest entities read, white space single."""
    out = F.regexp_replace(x, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def title(html: str | Column) -> Column:
    return text_of(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def counted_elements(pages: DataFrame, prefix: str, fields: dict[str, str], html: str = "html", joint: str = "-") -> DataFrame:
    """A row for each n in a page's elements with id prefix{field}-{n}, as listings number them, fields (new name: field) as columns of clean text.
    prefix{n}-{field} where joint is 'n-first'."""
    number_first = joint == "n-first"
    name, at = (r"(\d+)-([A-Za-z]+)", (2, 1)) if number_first else (r"([A-Za-z]+)-(\d+)", (1, 2))
    pattern = rf"(?is)id=[\"']{re.escape(prefix)}{name}[\"'][^>]*>(.*?)</(?:div|td|span|p|li)>"
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), 0), lambda m: F.struct(F.regexp_extract(m, pattern, at[0]).alias("field"), F.regexp_extract(m, pattern, at[1]).cast("int").alias("n"), clean(text_of(F.regexp_replace(m, r"^[^>]*>", ""))).alias("text"), F.nullif(F.regexp_extract(m, r"href=[\"']([^\"']*)", 1), F.lit("")).alias("href")))
    keys = [c for c in pages.columns if c != html]
    cells = [F.first(F.when(F.col("field") == old, F.col("text")), ignorenulls=True).alias(new) for new, old in fields.items()]
    return pages.select(*keys, F.inline(found)).groupBy(*keys, "n").agg(*cells, F.first("href", ignorenulls=True).alias("href"))


def listing(pages: DataFrame, prefix: str, fields: dict[str, str], id_pattern: str = r"/(\d+)/") -> DataFrame:
    """counted_elements with source_id from the link, and names without a trailing '#'."""
    out = counted_elements(pages, prefix, fields).withColumn("source_id", F.nullif(F.regexp_extract("href", id_pattern, 1), F.lit("")))
    return out.withColumn("name", F.trim(F.regexp_replace("name", r"\s*#\s*$", ""))) if "name" in out.columns else out


def without_totals(df: DataFrame, season: str = "season", total: str = TOTAL) -> DataFrame:
    return df.where(F.col(season).isNotNull() & (F.col(season) != total))


def labelled_field(html: str | Column, label: str, heading: str = "h2", value: str = "span") -> Column:
    """Text of the first `value` element after a heading whose text is label, whatever its case; null without one."""
    pattern = rf"(?is)<{heading}[^>]*>\s*{re.escape(label)}\s*</{heading}>\s*<{value}[^>]*>(.*?)</{value}>"
    return F.nullif(text_of(F.regexp_extract(html, pattern, 1)), F.lit(""))


def links(pages: DataFrame, pattern: str, names: list[str], html: str = "html") -> DataFrame:
    """Links whose address matches pattern (its groups become the named columns), with position and text."""
    each = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), 0), lambda m, i: F.struct(F.regexp_extract(m, r"href=[\"']([^\"']*)", 1).alias("href"), text_of(m).alias("text"), i.alias("position")))
    out = pages.select(*[c for c in pages.columns if c != html], F.inline(each)).where(F.col("href").rlike(pattern))
    return out.withColumns({n: F.regexp_extract("href", pattern, i + 1) for i, n in enumerate(names)})


def teams(pages: DataFrame, html: str = "html", signature=STANDINGS) -> DataFrame:
    """team_id, slug, name of the teams in a standings table: the first id and the longest text of a slug's links, in the order of the table."""
    found = links(pages, CLUB_LINK, ["slug", "team_id"], html)
    known = found.groupBy("slug").agg(F.min_by("team_id", "position").cast("int").alias("team_id"), F.max_by("text", F.struct(F.length("text"), -F.col("position"))).alias("name"))
    rows = tables(pages, html, list(signature), "sort_value").select(F.get("values", F.lit(1)).alias("slug"), "row").where("slug is not null and slug <> ''")
    order = rows.groupBy("slug").agg(F.min("row").alias("place"))
    return known.join(order, "slug").select("team_id", "slug", "name", "place")


class _Tables(HTMLParser):
    """All tables of a page: rows of cells (tag, text, sort value, first link), with the text of the last heading before each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.heading, self.in_heading, self.cell = [], [], "", False, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("h2", "h3"):
            self.heading, self.in_heading = "", True
        elif tag == "table":
            self.found.append({"heading": " ".join(self.heading.split()), "rows": []})
            self.open.append(self.found[-1])
        elif tag == "tr" and self.open:
            self.open[-1]["rows"].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.cell = {"tag": tag, "parts": [], "sort": a.get("data-sort-value"), "href": None}
            self.open[-1]["rows"][-1].append(self.cell)
        elif tag == "a" and self.cell is not None and self.cell["href"] is None:
            self.cell["href"] = a.get("href")

    def handle_endtag(self, tag):
        if tag in ("h2", "h3"):
            self.in_heading = False
        elif tag in ("td", "th"):
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.in_heading:
            self.heading += data
        if self.cell is not None and data.strip():
            self.cell["parts"].append(data.strip())


def page_tables(html: str | None) -> list[dict]:
    parser = _Tables()
    parser.feed(html or "")
    return parser.found


def tables(pages: DataFrame, html: str, signature: list[str], what: str = "text", heading: list[str] | None = None) -> DataFrame:
    """Rows of each page's first table whose headers hold the signature (and that stands under one of the headings): row, headers, values (text, or the
    cells' sort values), hrefs. Rows with fewer cells than headers go, unless sort values are asked for."""
    keys = [c for c in pages.columns if c != html]
    schema = pages.select(*keys).schema.simpleString()[7:-1]

    def read(batches):
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                for table in page_tables(record[html]):
                    head = [" ".join(c["parts"]) for r in table["rows"] for c in r if c["tag"] == "th"]
                    if any(s not in head for s in signature) or heading and not any(h.lower() in table["heading"].lower() for h in heading):
                        continue
                    first = [" ".join(c["parts"]) for c in table["rows"][0] if c["tag"] == "th"] or head
                    for i, cells in enumerate(table["rows"]):
                        if i and (what == "sort_value" or len(cells) >= len(first)):
                            values = [c["sort"] if what == "sort_value" else " ".join(c["parts"]) for c in cells]
                            out.append([*(record[k] for k in keys), i, first, values, [c["href"] for c in cells]])
                    break
            yield pd.DataFrame(out, columns=[*keys, "row", "headers", "values", "hrefs"])

    return pages.mapInPandas(read, f"{schema + ', ' if schema else ''}row int, headers array<string>, values array<string>, hrefs array<string>".replace(":", " ", len(keys)))


def cell(*names: str) -> Column:
    """The value under the first of several header names that a table has."""
    at = [F.nullif(F.array_position("headers", n), F.lit(0)) for n in names]
    return F.get("values", (F.coalesce(*at) - 1).cast("int"))


def team_stats(pages: DataFrame, html: str = "html", columns=STATISTICS, name: str = PERSON_HEADER, team: str = TEAM_HEADER, position: str = POSITION_HEADER) -> DataFrame:
    """Person rows of a team's statistics page, with id and slug from the name's link."""
    out = tables(pages, html, [name, team, position, "GP", "G", "A", "P"])
    link = F.get("hrefs", (F.array_position("headers", name) - 1).cast("int"))
    keys = [c for c in pages.columns if c != html]
    return out.select(*keys, cell(name).alias("name"), cell(team).alias("team"), cell(position).alias("position"), *[cell(c).try_cast("double").alias(c.lower()) for c in columns], F.nullif(F.regexp_extract(link, PERSON_LINK, 1), F.lit("")).alias("slug"), F.regexp_extract(link, PERSON_LINK, 2).try_cast("bigint").alias("source_id"))


def squad(pages: DataFrame, html: str = "html", headings=COUNTRY_HEADINGS) -> DataFrame:
    """Roster rows under one of the country headings: name without captain's mark, name_normalized, position, birth_date, birth_year, club."""
    rows = tables(pages, html, [], heading=list(headings)).withColumn("name", clean_name(cell(*NAMES))).where("name <> ''")
    born = date_in_parentheses(F.coalesce(cell(*BIRTHDATES), F.lit("")))
    keys = [c for c in pages.columns if c != html]
    return rows.select(*keys, "name", normalize_name("name", strip_marker=False).alias("name_normalized"), cell(SQUAD_POSITION).alias("position"), born["iso"].alias("birth_date"), born["year"].alias("birth_year"), cell(*CLUBS).alias("club"))
