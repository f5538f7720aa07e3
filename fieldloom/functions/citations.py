"""Citations: authors, years, study areas, and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import blank


def _some(c: Column) -> Column:
    """c, null where empty; c is evaluated once."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def first_author(c: Column | str) -> Column:
    """Surname that a citation starts with, else its first word in capitals; empty if none."""
    text = blank(c)
    return F.initcap(F.coalesce(_some(F.regexp_extract(text, r"^([A-Z][A-Za-z'\-]+)", 1)), _some(F.regexp_extract(text, r"\b([A-Z]{2,})\b", 1)), F.lit("")))


def cited_year(c: Column | str) -> Column:
    """First year from 1950 to 2029; empty if none."""
    return F.regexp_extract(blank(c), V.CITED_YEAR, 1)


def study_area(c: Column | str) -> Column:
    """The area that a title names: "in the Gulf of Kutch", or one in parentheses; empty if none."""
    text = blank(c)
    first = F.regexp_replace(F.trim(F.regexp_extract(text, V.STUDY_AREA[0], 1)), r",+$", "")
    return F.coalesce(_some(first), _some(F.trim(F.regexp_extract(text, V.STUDY_AREA[1], 1))), F.lit(""))


def without_authority_years(c: Column | str) -> Column:
    text = blank(c)
    return F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, V.AUTHORITY_YEAR, "")).otherwise(text)


def latest_year(c: Column | str, drop_authority: bool = False) -> Column:
    """The latest year in a text; null if none."""
    text = without_authority_years(c) if drop_authority else blank(c)
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(V.YEAR), 1), lambda y: y.cast("int")))


def sampling_year(c: Column | str) -> Column:
    """Year of a sampling event told as JSON (date, eventDate, year or samplingYear) or as text."""
    text = blank(c)
    told = F.coalesce(*[_some(F.get_json_object(text, f"$.{k}")) for k in ("date", "eventDate", "year", "samplingYear")])
    return latest_year(F.when(text.startswith("{"), told).otherwise(text), True)


def publication_year(c: Column | str) -> Column:
    """Year after the author group, else in parentheses, else the latest that is no authority's."""
    text = without_authority_years(c)
    after = F.regexp_extract(text, r"(?:^|[;,.])\s*[\w.\-]+\s+(\d{4})(?=\b[^(])", 1)
    inside = F.regexp_extract(text, r"\((\d{4})\)", 1)
    return F.coalesce(_some(after).cast("int"), _some(inside).cast("int"), latest_year(text))


def doi(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(blank(c), V.DOI, 1), r"[.,;)]+$", "")


def cite_names(authors: Column) -> Column:
    """One name, up to three joined by &, or the first and et al.; Anonymous if none."""
    n = F.coalesce(F.size(authors), F.lit(0))
    return F.when(n <= 0, "Anonymous").when(n <= 3, F.array_join(authors, " & ")).otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))


def reference_line(authors: Column, year: Column, title: Column, kind: Column, journal: Column, volume: Column, issue: Column, pages: Column, doi_: Column, publisher: Column) -> Column:
    """A reference in author-date style."""
    who, when, what = cite_names(authors), F.coalesce(_some(blank(year)), F.lit("n.d.")), F.coalesce(_some(blank(title)), F.lit("Untitled"))
    more = lambda before, x, after="": F.coalesce(F.when(blank(x) != "", F.concat(F.lit(before), blank(x), F.lit(after))), F.lit(""))
    paper = F.concat(who, F.lit(" ("), when, F.lit('). "'), what, F.lit('." *'), blank(journal), F.lit("*"), F.when(blank(volume) != "", F.concat(more(", ", volume), more("(", issue, ")"))).otherwise(""), more(": ", pages), more(". https://doi.org/", doi_), F.lit("."))
    book = F.concat(who, F.lit(" ("), when, F.lit("). *"), what, F.lit("*. "), blank(publisher), F.lit("."))
    return F.when(F.coalesce(_some(blank(kind)), F.lit("journal")) == "journal", paper).when(kind == "book", book).otherwise(F.concat(who, F.lit(" ("), when, F.lit("). "), what, F.lit(".")))


def bibtex_entry(key: Column, authors: Column, year: Column, title: Column, kind: Column, journal: Column, volume: Column, issue: Column, pages: Column, doi_: Column, publisher: Column) -> Column:
    fields = lambda pairs: F.concat_ws(",\n", *[F.concat(F.lit(f"  {n} = {{"), blank(c), F.lit("}")) for n, c in pairs])
    names = F.array_join(F.coalesce(authors, F.array().cast("array<string>")), " and ")
    paper = fields([("author", names), ("year", year), ("title", title), ("journal", journal), ("volume", volume), ("number", issue), ("pages", pages), ("doi", doi_)])
    book = fields([("author", names), ("year", year), ("title", title), ("publisher", publisher)])
    is_paper = F.coalesce(_some(blank(kind)), F.lit("journal")) == "journal"
    return F.concat(F.when(is_paper, "@article{").otherwise("@book{"), key, F.lit(",\n"), F.when(is_paper, paper).otherwise(book), F.lit("\n}"))


def citation_text(authors: Column, year: Column, title: Column, journal: Column) -> Column:
    """Up to four authors, year, title and journal; what is blank is left out."""
    return F.concat_ws(". ", _some(F.array_join(F.slice(authors, 1, 4), "; ")), _some(blank(year)), _some(blank(title)), _some(blank(journal)))


def file_stem(author: Column, year: Column, title: Column, most: int = 80) -> Column:
    """A file name stem of letters, digits and underscores."""
    text = F.concat_ws("_", _some(blank(author)), _some(blank(year)), _some(F.substring(blank(title), 1, 60)))
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def looks_like_file(c: Column | str) -> Column:
    """Whether a citation is a file name or too short to be one."""
    text = blank(c)
    return (F.length(text) < 20) | F.lower(text).rlike(r"\.(pdf|txt|md|docx?)$")
