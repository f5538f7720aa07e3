"""Species and locality articles derived from records, and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import citations, text
from fieldloom.functions.names import blank
from fieldloom.operators.dedup import record_name


def _some(c: Column | str) -> Column:
    return F.nullif(blank(c), F.lit(""))


def species_articles(df: DataFrame, seq: str) -> DataFrame:
    """Per species: first filled taxonomy, distinct localities, habitats, points and citations, records, first record.

    Points are told apart by locality and citation; the arrays are sorted.
    """
    first = lambda f: F.min_by(_some(f), F.when(_some(f).isNotNull(), F.col(seq))).alias(f)
    point = F.when(F.col("decimalLatitude").isNotNull(), F.struct(F.md5(F.concat_ws("_", blank("verbatimLocality"), blank("sourceCitation"))).alias("key"), F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon")))
    every = lambda f: F.sort_array(F.collect_set(_some(f)))
    rows = df.withColumn("species", record_name()).where("species IS NOT NULL")
    return rows.groupBy("species").agg(*[first(f) for f in ("phylum", "class_", "order_", "family_")], every("verbatimLocality").alias("localities"), every("habitat").alias("habitats"), every("sourceCitation").alias("citations"), F.sort_array(F.collect_set(point)).alias("points"), F.bool_or(F.lower(blank("occurrenceType")).isin("", "primary")).alias("has_primary"), F.count(F.lit(1)).alias("n_records"))


def locality_articles(df: DataFrame, seq: str) -> DataFrame:
    """Per locality: its species, and the coordinates that were first told."""
    rows = df.withColumn("species", record_name()).withColumn("locality", _some("verbatimLocality")).where("species IS NOT NULL AND locality IS NOT NULL")
    at = F.min_by(F.struct("decimalLatitude", "decimalLongitude"), F.when(F.col("decimalLatitude").isNotNull(), F.col(seq)))
    return rows.groupBy("locality").agg(F.sort_array(F.collect_set("species")).alias("checklist"), at.alias("at")).select("locality", "checklist", F.size("checklist").alias("n_species"), F.col("at.decimalLatitude").alias("lat"), F.col("at.decimalLongitude").alias("lon"))


def lead_sentence(articles: DataFrame) -> DataFrame:
    """articles with a lead made of their aggregated fields."""
    family = F.when(_some("family_").isNotNull(), F.concat(F.lit(" is a species of the family "), F.col("family_"))).otherwise(" is a species")
    where = F.when(F.size("localities") > 0, F.concat(F.lit(" recorded from "), F.array_join(F.slice("localities", 1, 3), ", "))).otherwise("")
    return articles.withColumn("lead", F.concat("species", family, where, F.lit(".")))


def depth_sentence(df: DataFrame, species: str, depth: str) -> DataFrame:
    """Per species the range of its depths as a sentence; none without depths."""
    d = F.col(depth).try_cast("double")
    out = df.groupBy(species).agg(F.min(d).alias("lo"), F.max(d).alias("hi")).where("lo IS NOT NULL")
    return out.select(species, F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("Recorded at a depth of "), F.col("lo").cast("string"), F.lit(" m."))).otherwise(F.concat(F.lit("Recorded at depths of "), F.col("lo").cast("string"), F.lit(" to "), F.col("hi").cast("string"), F.lit(" m."))).alias("sentence"))


def references(df: DataFrame, seq: str) -> DataFrame:
    """species, citation, number: citations numbered by first use within a species."""
    from fieldloom.operators.dedup import numbered_first_seen

    rows = df.select(record_name().alias("species"), _some("sourceCitation").alias("citation"), seq).where("species IS NOT NULL AND citation IS NOT NULL")
    return numbered_first_seen(rows, ["species"], "citation", seq)


def citation_index(sections: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """key, cite, number: [cite:KEY] marks numbered by first appearance over an article's sections."""
    from fieldloom.operators.dedup import numbered_first_seen

    marks = sections.select(key, order, F.posexplode(text.matches(body, r"\[cite:([^\]]+)\]", 1)).alias("p", "cite"))
    return numbered_first_seen(marks.withColumn("at", F.struct(order, "p")), [key], "cite", "at")


def resolve_citations(sections: DataFrame, index: DataFrame, key: str, body: str) -> DataFrame:
    """sections with their marks replaced by numbers."""
    maps = index.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("cite", "number"))).alias("__i"))
    joined = sections.join(maps, key, "left")
    return joined.withColumn(body, F.when(F.col("__i").isNull(), F.col(body)).otherwise(text.cite_numbers(body, F.col("__i")))).select(*sections.columns)


REFERENCE_FIELDS = ("authors", "year", "title", "source_type", "journal_name", "volume", "issue", "pages", "doi", "publisher")


def bibliography(refs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """key, bibliography: numbered reference lines. refs: cite and REFERENCE_FIELDS."""
    line = citations.reference_line(*[F.col(f) for f in REFERENCE_FIELDS])
    rows = index.join(refs, "cite").select(key, "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), line).alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "line"))), lambda s: s["line"]), "\n").alias("bibliography"))


def bibtex(refs: DataFrame) -> DataFrame:
    """refs with a BibTeX entry each."""
    return refs.select("cite", citations.bibtex_entry(F.col("cite"), *[F.col(f) for f in REFERENCE_FIELDS]).alias("entry"))


def markdown(articles: DataFrame) -> DataFrame:
    """species, body: an article as Markdown."""
    item = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {head}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    tax = F.concat_ws(" > ", *[_some(c) for c in ("phylum", "class_", "order_", "family_")])
    return articles.select("species", F.concat_ws("\n\n", F.concat(F.lit("# "), "species"), F.col("lead"), F.when(tax != "", F.concat(F.lit("## Classification\n"), tax)), item("Localities", F.col("localities")), item("Habitats", F.col("habitats")), item("References", F.col("citations"))).alias("body"))


def html(articles: DataFrame) -> DataFrame:
    """species, body: an article as HTML with numbered references."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    refs = F.transform("citations", lambda x, i: F.concat(F.lit('<li id="ref-'), (i + 1).cast("string"), F.lit('">'), esc(x), F.lit("</li>")))
    return articles.select("species", F.concat(F.lit("<h1>"), esc(F.col("species")), F.lit("</h1><p>"), esc(F.coalesce("lead", F.lit(""))), F.lit("</p><ol>"), F.array_join(refs, ""), F.lit("</ol>")).alias("body"))


def prefer_longer(old: Column, new: Column) -> Column:
    return F.when(F.length(blank(new)) > F.length(blank(old)), new).otherwise(F.coalesce(old, new))


def append_once(body: Column, addition: Column) -> Column:
    """body with a passage added unless it holds it."""
    return F.when(F.contains(F.coalesce(body, F.lit("")), addition), body).otherwise(F.concat_ws("\n\n", _some(body), addition))


def species_map(df: DataFrame) -> DataFrame:
    """Points to draw: species, lat, lon, depth layer."""
    return df.where("decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL").select(record_name().alias("species"), F.col("decimalLatitude").alias("lat"), F.col("decimalLongitude").alias("lon"), blank("occurrenceType").alias("layer"))


def article_bodies(df: DataFrame, body: str) -> DataFrame:
    """df with article (VARIANT) of its JSON text, and malformed: whether there is a text that is no JSON."""
    parsed = F.try_parse_json(F.col(body))
    return df.withColumns({"article": parsed, "malformed": F.col(body).isNotNull() & parsed.isNull()})


def article_fields(df: DataFrame, fields: dict[str, tuple[str, str]], article: str = "article") -> DataFrame:
    """df with fields of its articles: name to (path, type); null where an article lacks one or holds another type."""
    return df.withColumns({name: F.try_variant_get(article, path, kind) for name, (path, kind) in fields.items()})


def article_changed(article: Column | str, **changes: Column) -> Column:
    """An article with members set; those of one name are replaced. What is no object has only the changes."""
    old = F.try_variant_get(article, "$", "map<string,variant>")
    new = F.map_from_arrays(F.array(*map(F.lit, changes)), F.array(*[F.parse_json(F.to_json(F.struct(v.alias("v")))).alias("v") for v in changes.values()]))
    new = F.transform_values(new, lambda k, v: F.variant_get(v, "$.v", "variant"))
    kept = F.map_filter(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, v: ~k.isin(*changes))
    return F.to_variant_object(F.map_concat(kept, new))


def article_text(article: Column | str) -> Column:
    """An article as JSON text, members by name."""
    return F.to_json(article)


def article_schema(df: DataFrame, by: list[str], article: str = "article") -> DataFrame:
    """Per group the schema that fits all its articles: fields of any of them, types widened."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(article).alias("schema"))
