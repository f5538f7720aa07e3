"""Tables inside texts: detection, column meaning, and prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import vocabulary as V
from fieldloom.functions.names import col
from fieldloom.operators.segment import flat_map

RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


def cells_of(line: str, mark: str) -> list[str]:
    body = line.strip()
    if mark == "|":
        body = body.removeprefix("|").removesuffix("|")
    return [c.strip() for c in body.split(mark)]


def find_tables(doc: str, columns: int = 3, rows: int = 2) -> list[dict]:
    """Tables of neighbouring lines with enough pipes or tabs: start, stop, mark, header, rows, kinds, confidence.

    A rule line under the first makes it the header; rows are filled up to the
    widest. Column meanings come from the header where there is one, else from
    the rows. Each line belongs to one table only.
    """
    found, run, at = [], [], 0

    def close():
        if len(run) >= rows:
            mark = run[0][2]
            lines = [x[3] for x in run]
            ruled = len(lines) > 1 and bool(RULE.match(lines[1]))
            body = [cells_of(x, mark) for i, x in enumerate(lines) if not RULE.match(x) and not (ruled and i == 0)]
            header = cells_of(lines[0], mark) if ruled else []
            width = max(map(len, [*body, header]), default=0)
            if body and width >= columns and (ruled or len(body) >= rows):
                body = [r + [""] * (width - len(r)) for r in body]
                found.append({"start": run[0][0], "stop": run[-1][1], "mark": mark, "header": header, "rows": body, "kinds": kinds_of(header, body, width), "confidence": 0.95 if ruled else 0.9})
        run.clear()

    for line in doc.splitlines(keepends=True):
        text = line.rstrip("\n")
        mark = "|" if text.count("|") >= columns - 1 else "\t" if text.count("\t") >= columns - 1 else None
        if run and mark != run[0][2]:
            close()
        if mark:
            run.append((at, at + len(line), mark, text))
        at += len(line)
    close()
    return found


def kinds_of(header: list[str], rows: list[list[str]], width: int) -> list[str]:
    """What each column holds, by the words of its header, else of its first rows."""

    def kind(i: int) -> str:
        told = (header[i] if i < len(header) else "") or " ".join(r[i] for r in rows[:5])
        return next((k for k, p in V.COLUMN_KINDS if re.search(p, told.lower())), "")

    kinds = [kind(i) for i in range(width)]
    if "species" not in kinds:
        named = [i for i in range(width) if rows and sum(bool(re.search(V.BINOMIAL, r[i])) for r in rows) * 2 > len(rows)]
        if named:
            kinds[named[0]] = "species"
    return kinds


def row_sentence(row: list[str], kinds: list[str], verbose: bool = False) -> str:
    """A table row as a sentence about its species; empty without one."""
    told: dict[str, str] = {}
    for kind, cell in zip(kinds, row, strict=False):
        if kind and cell:
            told.setdefault(kind, cell)
    if "species" not in told:
        return ""
    out = ("The species " if verbose else "") + told["species"]
    if "location" in told:
        out += f" was found at {told['location']}" + (f" in {told['date']}" if "date" in told else "")
    elif "date" in told:
        out += f" was observed in {told['date']}"
    if "habitat" in told:
        out += f" in {told['habitat']} habitat"
    if "notes" in told:
        out += f" ({told['notes']})"
    return out + "."


def prose_of(doc: str) -> str:
    """The text with each table that tells of species replaced by sentences."""
    out, at = [], 0
    for t in find_tables(doc):
        prose = " ".join(filter(None, (row_sentence(r, t["kinds"]) for r in t["rows"])))
        if prose:
            out += [doc[at : t["start"]], prose + "\n"]
            at = t["stop"]
    return "".join([*out, doc[at:]])


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, start, stop, mark, n_rows, n_columns, kinds, confidence, prose."""

    def make(doc: str):
        for n, t in enumerate(find_tables(doc)):
            yield n, t["start"], t["stop"], t["mark"], len(t["rows"]), len(t["kinds"]), t["kinds"], t["confidence"], " ".join(filter(None, (row_sentence(r, t["kinds"]) for r in t["rows"])))

    return flat_map(docs, id_col, text_col, make, "n int, start int, stop int, mark string, n_rows int, n_columns int, kinds array<string>, confidence double, prose string")


def without_tables(c: Column | str) -> Column:
    """A text with its tables told as sentences."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else prose_of(t))

    return run(col(c))
