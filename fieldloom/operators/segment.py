"""Segmentation of documents into sections, paragraphs, sentences and chunks with offsets.

Offset-bearing and packing steps look at one document at a time, in Arrow
batches; a document of any length is one row's work. Every chunk's text equals
the document's text between its offsets unless a column says that context was
added, and every packing loop advances at each step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import keys, text
from fieldloom.functions import vocabulary as V

HEADING = re.compile(r"^#{1,4}\s+(.+)$", re.M)
BLANK_LINE = re.compile(r"\n\s*\n")
SENTENCE = re.compile(V.SENTENCE_END)
PIPE_ROW = re.compile(r"^\s*\|.*\|\s*$")

Span = tuple[int, int]


def section_spans(doc: str) -> list[tuple[str, int, int]]:
    """(heading, start, stop) of each section's body; what precedes the first heading has none."""
    heads = list(HEADING.finditer(doc))
    out = [("", 0, heads[0].start() if heads else len(doc))]
    out += [(h[1].strip(), h.end(), heads[i + 1].start() if i + 1 < len(heads) else len(doc)) for i, h in enumerate(heads)]
    return [x for x in out if doc[x[1] : x[2]].strip()]


def _trimmed(doc: str, start: int, stop: int) -> Span:
    part = doc[start:stop]
    return start + len(part) - len(part.lstrip()), start + len(part.rstrip())


def cut_spans(doc: str, span: Span, pattern: re.Pattern, longer_than: int) -> list[Span]:
    """Trimmed parts of a span between matches of a pattern, those longer than a length."""
    out, at = [], span[0]
    for m in [*pattern.finditer(doc, span[0], span[1]), None]:
        start, stop = _trimmed(doc, at, m.start() if m else span[1])
        if stop - start > longer_than:
            out.append((start, stop))
        if m:
            at = m.end()
    return out


def pack_spans(spans: list[Span], most: int) -> list[list[Span]]:
    """Neighbouring spans in groups that reach over at most ``most`` characters; a longer span stands alone."""
    groups: list[list[Span]] = []
    for s in spans:
        if groups and s[1] - groups[-1][0][0] <= most:
            groups[-1].append(s)
        else:
            groups.append([s])
    return groups


def hard_cut(span: Span, most: int) -> list[Span]:
    return [(a, min(a + most, span[1])) for a in range(span[0], span[1], most)]


def fine_spans(doc: str, span: Span, most: int) -> list[Span]:
    """A span in sentences, those that are too long cut at length."""
    return [p for s in cut_spans(doc, span, SENTENCE, 0) for p in (hard_cut(s, most) if s[1] - s[0] > most else [s])]


def with_overlap(groups: list[list[Span]], overlap: int) -> list[tuple[int, int, int]]:
    """(start, stop, fresh): each group extended backwards over whole spans of the one before, up to ``overlap``."""
    out = []
    for i, g in enumerate(groups):
        start = g[0][0]
        if i and overlap:
            back = [s for s in groups[i - 1][1:] if g[0][0] - s[0] <= overlap]
            start = back[0][0] if back else start
        out.append((start, g[-1][1], g[0][0]))
    return out


def flat_map(docs: DataFrame, id_col: str, text_col: str, make: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """id and the fields of each row that make(text) gives. A null text gives none."""
    names = [f.split()[0] for f in fields.split(", ")]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in make(doc) if doc is not None else ():
                    ids.append(i)
                    rows.append(row)
                    if len(rows) == 5000:
                        yield table(ids, rows, batch)
                        ids, rows = [], []
            yield table(ids, rows, batch)

    def table(ids, rows, batch):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names=["id", *names])

    arrow = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    types = [arrow[f.split(" ", 1)[1]] for f in fields.split(", ")]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, heading, role, start, stop, body."""
    make = lambda doc: ((n, h, a, b, doc[a:b]) for n, (h, a, b) in enumerate(section_spans(doc)))
    return flat_map(docs, id_col, text_col, make, "n int, heading string, start int, stop int, body string").withColumn("role", text.section_role("heading"))


def levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections (0), paragraphs (1) and sentences (2): id, level, n, parent, heading, start, stop, body, has_species, has_locality."""

    def make(doc: str):
        n = [0, 0, 0]
        for heading, a, b in section_spans(doc):
            yield 0, n[0], -1, heading, a, b, doc[a:b]
            for p in cut_spans(doc, (a, b), BLANK_LINE, 20):
                yield 1, n[1], n[0], heading, *p, doc[p[0] : p[1]]
                for s in cut_spans(doc, p, SENTENCE, 10):
                    yield 2, n[2], n[1], heading, *s, doc[s[0] : s[1]]
                    n[2] += 1
                n[1] += 1
            n[0] += 1

    out = flat_map(docs, id_col, text_col, make, "level int, n int, parent int, heading string, start int, stop int, body string")
    return out.withColumns({"has_species": text.names_species("body"), "has_locality": F.size(text.places_named("body")) > 0})


def new_documents(docs: DataFrame, seen: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents whose hash (doc_hash) the seen table lacks."""
    return docs.withColumn("doc_hash", keys.document_hash(text_col)).join(seen.select("doc_hash"), "doc_hash", "left_anti")


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4000, overlap: int = 200, by: str = "sections") -> DataFrame:
    """id, n, heading, start, stop, fresh, body: pieces of at most ``most`` characters besides the overlap.

    by: sections (never across headings), paragraphs, sentences or fixed. Text
    from ``fresh`` on is new; what precedes it repeats the chunk before.
    """

    def make(doc: str):
        n = 0
        areas = section_spans(doc) if by == "sections" else [("", 0, len(doc))]
        for heading, a, b in areas:
            if by == "fixed":
                step = most - overlap
                cut = [(s, min(s + most, b), s if s == a else s + overlap) for s in range(a, max(b - overlap, a + 1), step)]
            elif by == "sentences":
                cut = with_overlap(pack_spans(fine_spans(doc, (a, b), most), most), overlap)
            else:
                parts = [q for p in cut_spans(doc, (a, b), BLANK_LINE, 0) for q in (fine_spans(doc, p, most) if p[1] - p[0] > most else [p])]
                cut = with_overlap(pack_spans(parts, most), overlap)
            for start, stop, fresh in cut:
                yield n, heading, start, stop, fresh, doc[start:stop]
                n += 1

    return flat_map(docs, id_col, text_col, make, "n int, heading string, start int, stop int, fresh int, body string")


def table_safe_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4000) -> DataFrame:
    """id, n, start, stop, has_table, body: chunks that never cut a table of pipe rows."""

    def parts(doc: str) -> list[tuple[int, int, bool]]:
        out, at = [], 0
        for line in doc.splitlines(keepends=True):
            row = bool(PIPE_ROW.match(line))
            if out and (row and out[-1][2] or not row and not out[-1][2]):
                out[-1] = (out[-1][0], at + len(line), row)
            else:
                out.append((at, at + len(line), row))
            at += len(line)
        return out

    def make(doc: str):
        units = []
        for a, b, row in parts(doc):
            units += [(a, b, True)] if row else [(*s, False) for s in fine_spans(doc, (a, b), most)]
        groups: list[list[tuple[int, int, bool]]] = []
        for u in units:
            if groups and u[1] - groups[-1][0][0] <= most:
                groups[-1].append(u)
            else:
                groups.append([u])
        for n, g in enumerate(groups):
            yield n, g[0][0], g[-1][1], any(u[2] for u in g), doc[g[0][0] : g[-1][1]]

    return flat_map(docs, id_col, text_col, make, "n int, start int, stop int, has_table boolean, body string")


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4000, overlap: int = 200) -> DataFrame:
    """Chunks by sections where a document has headings, by paragraphs where it has blank lines, else by sentences; ``strategy`` tells which."""
    kind = F.when(F.col(text_col).rlike(r"(?m)^#{1,4}\s+\S"), "sections").when(F.col(text_col).rlike(r"\n\s*\n"), "paragraphs").otherwise("sentences")
    marked = docs.withColumn("__strategy", kind)
    parts = [chunks(marked.where(F.col("__strategy") == s), id_col, text_col, most, overlap, s).withColumn("strategy", F.lit(s)) for s in ("sections", "paragraphs", "sentences")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chunk_priority(df: DataFrame) -> DataFrame:
    return df.withColumn("priority", F.when(F.col("role").isin("RESULTS", "TAXONOMY", "TABLES", "METHODS"), 1.0).otherwise(0.6))


def study_context(section_table: DataFrame, id_col: str = "doc_id", most: int = 1500) -> DataFrame:
    """id, context: places, dates and depths that the methods and abstract tell."""
    c = text.locality_context("body")
    told = section_table.where(F.col("role").isin("METHODS", "ABSTRACT")).withColumn("__c", c).where((F.size("__c.localities") > 0) | (F.size("__c.dates") > 0))
    line = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head), F.array_join(x, ", ")))
    block = F.concat_ws("\n", F.concat(F.lit("[STUDY CONTEXT from "), "heading", F.lit(" section]")), line("Localities: ", F.slice("__c.localities", 1, 10)), line("Collection period: ", F.col("__c.dates")), line("Depth range: ", F.col("__c.depths")))
    return told.groupBy(id_col).agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))), lambda s: s["b"]), "\n\n"), 1, most).alias("context"))


def context_localities(context: Column | str) -> Column:
    found = F.regexp_extract(F.col(context) if isinstance(context, str) else context, r"Localities: ([^\n]*)", 1)
    return F.filter(F.transform(F.split(found, ","), lambda x: F.trim(x)), lambda p: p != "")


def with_context(chunk_table: DataFrame, contexts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """chunk_table with the document's study context before each body, in ``full_text``."""
    joined = chunk_table.join(contexts, id_col, "left")
    return joined.withColumn("full_text", F.concat_ws("\n\n", F.nullif(F.col("context"), F.lit("")), "body"))


def batches(chunk_table: DataFrame, id_col: str, order: str, size: Column, most: int) -> DataFrame:
    """chunk_table with the batch that next-fit packing puts each chunk into, in order, per document.

    A document's sizes are folded in one array; chunks themselves stay where they are.
    """
    sizes = chunk_table.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), size.alias("s")))).alias("all"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,batch:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["s"] <= most) | (acc["used"] == 0)
        batch = F.when(fits, acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"] + x["s"]).otherwise(x["s"]).cast("long")
        return F.struct(batch.alias("batch"), used.alias("used"), F.array_append(acc["out"], F.struct(x["o"].cast("long").alias("o"), batch.alias("batch"))).alias("out"))

    placed = sizes.select(id_col, F.explode(F.aggregate("all", zero, step, lambda acc: acc["out"])).alias("p"))
    return chunk_table.join(placed.select(id_col, F.col("p.o").alias(order), F.col("p.batch").alias("batch")), [id_col, order])


def batch_texts(packed: DataFrame, id_col: str, order: str, heading: str, body: str) -> DataFrame:
    """id, batch, text: each chunk under its heading."""
    part = F.concat(F.lit("### "), F.coalesce(F.col(heading), F.lit("")), F.lit("\n"), F.col(body))
    return packed.groupBy(id_col, "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t")))), lambda s: s["t"]), "\n\n").alias("text"))


def extraction_batches(level_table: DataFrame, id_col: str = "doc_id", reach: int = 5, species_only: bool = True, most: int = 6000) -> DataFrame:
    """id, n, paragraph, sentences, nearby: paragraphs with their sentences and the places named within ``reach`` sentences.

    Texts longer than ``most`` are told by ``parts``, how many batches they make.
    """
    sentences = level_table.where("level = 2").withColumn("places", text.places_named("body"))
    w = Window.partitionBy(id_col).orderBy("n").rangeBetween(-reach, reach)
    near = sentences.withColumn("near", F.array_distinct(F.flatten(F.collect_list("places").over(w))))
    grouped = near.groupBy(id_col, F.col("parent").alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "body"))), lambda s: s["body"]).alias("sentences"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("nearby"))
    paragraphs = level_table.where("level = 1").select(id_col, "n", F.col("body").alias("paragraph"), "heading", "has_species")
    rows = paragraphs.where("has_species") if species_only else paragraphs
    return rows.join(grouped, [id_col, "n"], "left").withColumn("parts", F.greatest(F.lit(1), F.ceil(F.length("paragraph") / most)).cast("int"))


def batch_context(df: DataFrame) -> DataFrame:
    """df with the prompt layout of an extraction batch."""
    lines = F.transform("sentences", lambda s: F.concat(F.lit("- "), s))
    return df.withColumn("context", F.concat_ws("\n", F.concat(F.lit("Section: "), F.coalesce("heading", F.lit(""))), F.concat(F.lit("Paragraph: "), "paragraph"), F.when(F.size("sentences") > 0, F.concat(F.lit("Sentences:\n"), F.array_join(lines, "\n"))), F.when(F.size("nearby") > 0, F.concat(F.lit("Nearby places: "), F.array_join(F.slice("nearby", 1, 5), ", ")))))


def table_columns(df: DataFrame, body: str = "body") -> DataFrame:
    """df with how many table rows and columns its text has."""
    rows = text.matches(body, r"(?m)^\s*\|.*\|\s*$")
    cells = F.array_max(F.transform(rows, lambda r: F.size(F.split(r, r"\|")) - 2))
    return df.withColumns({"table_rows": F.size(rows), "table_columns": F.coalesce(cells, F.lit(0))})
