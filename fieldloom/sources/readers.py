"""Tables from files: delimited with loose headers, binary documents, cached texts, layers, and pages of a service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import citations, coords, keys, places, text
from fieldloom.functions.names import blank
from fieldloom.operators.upserts import union_all
from fieldloom.schemas import fit_to, resolve

#: Columns of a postal table and the headers under which they come.
POSTAL = {
    "postal_code": ("postal_code", "pincode", "pin", "zip"),
    "place_name": ("place_name", "place", "officename", "village"),
    "state_name": ("state_name", "statename", "state"),
    "county_name": ("county_name", "district", "districtname"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng", "long"),
}
#: Columns of an occurrence archive.
ARCHIVE = {"gbif_id": "string", "scientificName": "string", "decimalLatitude": "double", "decimalLongitude": "double", "country": "string", "eventDate": "string", "basisOfRecord": "string", "occurrenceStatus": "string", "locality": "string"}


def delimited(spark: SparkSession, path: str, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...], separator: str = "\t") -> DataFrame:
    """The wanted columns of a headed text table, all as text, whatever their order and spelling; fails without the required ones."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False, encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    found = resolve(raw.columns, wanted)
    missing = [c for c in required if c not in found]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return raw.select(*[(F.col(f"`{found[w]}`") if w in found else F.lit(None).cast("string")).alias(w) for w in wanted])


def postal_table(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A postal table with numeric coordinates; rows without a place are left out."""
    t = delimited(spark, path, POSTAL, ("postal_code", "place_name"), separator)
    return t.withColumns({c: coords.to_double(c) for c in ("latitude", "longitude")}).where(blank("place_name") != "")


def code_boxes(postal: DataFrame, margin: float = 0.1) -> DataFrame:
    """Box of each postal code: that of its district's points, widened."""
    rows = postal.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    district = rows.groupBy(F.lower(blank("state_name")).alias("s"), F.lower(blank("county_name")).alias("d")).agg(*[(f(c) + m).alias(n) for n, f, c, m in (("lat_min", F.min, "latitude", -margin), ("lat_max", F.max, "latitude", margin), ("lon_min", F.min, "longitude", -margin), ("lon_max", F.max, "longitude", margin))])
    codes = postal.groupBy(F.col("postal_code").alias("code")).agg(F.min(F.struct(F.lower(blank("state_name")).alias("s"), F.lower(blank("county_name")).alias("d"))).alias("k"))
    return codes.join(district, (F.col("k.s") == F.col("s")) & (F.col("k.d") == F.col("d"))).select("code", "lat_min", "lat_max", "lon_min", "lon_max")


def layers(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Villages and the administrative hierarchy of map layers with differing columns.

    villages: village, district, state, layer_name. admin: distinct state, district, block, subdistrict.
    """
    wanted = {"village": ("village", "vill_name", "name", "vname", "village_name"), "district": ("district", "dist_name", "dtname"), "state": ("state", "st_nm", "stname", "state_name"), "block": ("block", "block_name"), "subdistrict": ("subdistrict", "sdtname", "tehsil", "taluka")}

    def one(name: str, df: DataFrame) -> DataFrame:
        found = resolve(df.columns, wanted)
        return df.select(*[(F.trim(F.col(f"`{found[w]}`").cast("string")) if w in found else F.lit(None).cast("string")).alias(w) for w in wanted], F.lit(name).alias("layer_name"))

    rows = union_all(*[one(n, d) for n, d in tables.items()])
    villages = rows.where(blank("village") != "").select(F.initcap("village").alias("village"), "district", "state", "layer_name")
    return villages, rows.select("state", "district", "block", "subdistrict").where(blank("state") != "").distinct()


def binary_documents(spark: SparkSession, path: str, parse: Callable[[bytes], str], pattern: str = "*") -> DataFrame:
    """path, doc_hash, text of files, read by Spark and parsed on the executors. A file that parse rejects has no text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data in batch.column(1).to_pylist():
                try:
                    texts.append(parse(data))
                except Exception:  # noqa: BLE001  the parser is the caller's
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string").withColumn("doc_hash", keys.document_hash("text"))


def first_parser(*parsers: tuple[str, Callable[[bytes], str]]) -> Callable[[bytes], str]:
    """A parser that takes the first result with text in it."""

    def parse(data: bytes) -> str:
        for _, p in parsers:
            try:
                out = p(data)
            except Exception:  # noqa: BLE001  the next may do better
                continue
            if out and out.strip():
                return out
        return ""

    return parse


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, body of web pages; the title falls back to the first good line, then the address."""
    body = text.html_text("html")
    stem = F.regexp_replace(F.regexp_extract("url", r"([^/]+?)(?:\.\w+)?/?$", 1), r"[-_]+", " ")
    return pages.select("page_id", "url", text.best_title(text.html_title("html"), F.regexp_extract("html", r"(?is)<h1[^>]*>\s*([^<]+?)\s*</h1>", 1), stem).alias("title"), body.alias("body"))


def title_ladder(docs: DataFrame, told: list[str], body: str, file: str) -> DataFrame:
    """docs with title: the first told column that is no noise, else the largest-font or first good line, else the file's name."""
    stem = F.regexp_replace(F.regexp_extract(file, r"([^/]+?)(?:\.\w+)?$", 1), r"[-_]+", " ")
    return docs.withColumn("title", F.coalesce(F.nullif(text.best_title(*[F.col(c) for c in told], text.first_good_line(body)), F.lit("")), stem))


def largest_font_title(spans: DataFrame, doc: str) -> DataFrame:
    """doc, title: spans (doc, at, size, text) of the largest font of the first page, joined in order."""
    most = spans.groupBy(doc).agg(F.max("size").alias("__m"))
    return spans.join(most, doc).where(F.col("size") >= F.col("__m") - 0.5).groupBy(doc).agg(text.trimmed_title(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ")).alias("title"))


def paper_metadata(docs: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """docs (doc_id, doi, title) with authors, year, journal and citation from the first source that knows it.

    sources, best first: doi, title_key, authors, year, title, journal; a DOI match beats one by title.
    """
    fields = ["authors", "year", "journal"]
    out = docs.withColumns({"__doi": F.lower(blank("doi")), "__title": places.locality_key("title")})
    picks: dict[str, list] = {f: [] for f in fields}
    for i, (_, ref) in enumerate(sources):
        for by, key in (("doi", "__doi"), ("title_key", "__title")):
            r = ref.where(blank(by) != "").groupBy(F.lower(blank(by)).alias(key)).agg(F.min(F.struct(*fields)).alias(f"__{by}{i}"))
            out = out.join(r, key, "left")
    for by in ("doi", "title_key"):
        for i in range(len(sources)):
            for f in fields:
                picks[f].append(F.col(f"__{by}{i}.{f}"))
    out = out.select(*docs.columns, *[F.coalesce(*picks[f]).alias(f) for f in fields])
    return out.withColumns({"citation": citations.citation_text(F.col("authors"), F.col("year").cast("string"), F.col("title"), F.col("journal")), "file_stem": citations.file_stem(F.get("authors", F.lit(0)), F.col("year").cast("string"), F.col("title"))})


def cached_texts(docs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose hash the cache has, with its text, and those to parse."""
    return docs.join(cache.select("doc_hash", F.col("text").alias("cached_text")), "doc_hash"), docs.join(cache.select("doc_hash"), "doc_hash", "left_anti")


def occurrence_archive(df: DataFrame, country: str | None = None) -> DataFrame:
    """Archive rows with usable coordinates, each id once, told as feedback texts with their type."""
    t = fit_to(df, ARCHIVE)
    point = t["decimalLatitude"].between(-90, 90) & t["decimalLongitude"].between(-180, 180) & ~((t["decimalLatitude"] == 0) & (t["decimalLongitude"] == 0))
    rows = t.where(point & (blank("scientificName") != "") & ((F.lower("country") == country.lower()) if country else F.lit(True))).dropDuplicates(["gbif_id"])
    kind = F.when(F.lower(blank("occurrenceStatus")) == "absent", "Uncertain").when(F.lower(blank("basisOfRecord")).isin("human_observation", "preserved_specimen", "machine_observation", "occurrence"), "Primary").otherwise("Secondary")
    said = F.concat(F.col("scientificName"), F.lit(" was recorded at "), F.coalesce("locality", F.lit("an unnamed place")), F.lit(" in "), F.coalesce(F.substring("eventDate", 1, 4), F.lit("an unknown year")), F.lit("."))
    return rows.select("gbif_id", said.alias("text"), kind.alias("label"), "decimalLatitude", "decimalLongitude")


def annotations(spark: SparkSession, path: str, confidence: float = 0.95) -> DataFrame:
    """Labelled texts of a CSV file, with a confidence."""
    t = delimited(spark, path, {"text": ("text", "sentence"), "label": ("label", "type", "occurrence_type")}, ("text", "label"), ",")
    return t.where((blank("text") != "") & (blank("label") != "")).withColumn("confidence", F.lit(confidence))


def page_texts(pages: DataFrame, doc: str, order: str, body: str) -> DataFrame:
    """doc, text, scanned: pages joined in order, and whether they hold too little text to be more than pictures."""
    rows = pages.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, body))), lambda s: s[body]), "\n\n").alias("text"), F.avg(F.length(F.coalesce(F.col(body), F.lit("")))).alias("mean"))
    return rows.select(doc, text.clean_scan("text").alias("text"), text.is_scanned(F.col("mean")).alias("scanned"))


def dois(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, citations.doi(text_col).alias("doi")).where("doi <> ''")


def first_table(spark: SparkSession, *candidates: str) -> str:
    """The first of the named tables that the catalog has."""
    for name in candidates:
        if spark.catalog.tableExists(name):
            return name
    raise ValueError(f"none of {', '.join(candidates)} exists")
