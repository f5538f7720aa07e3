"""Inverted index, TF-IDF recall, relevance and other top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.functions.names import blank
from fieldloom.session import Workspace

TOKEN = r"[a-z0-9]{2,}"


def top_per(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark cuts each task's rows to k before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def terms(docs: DataFrame, id_col: str, text_col: str, grams: int = 2) -> DataFrame:
    """id, term, tf: words, and runs of up to ``grams`` words, with how often a document has them."""
    words = text.matches(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TOKEN)
    parts = [words] + [F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i, n=n: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>")) for n in range(2, grams + 1)]
    return docs.select(id_col, F.explode(F.concat(*parts)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, grams: int = 2, most_terms: int | None = None) -> DataFrame:
    """id, term, weight: (1 + ln tf)(ln((1 + n) / (1 + df)) + 1), unit length per document.

    ``most_terms`` keeps the terms that occur most often in all (a model size, not a row cap).
    """
    counts = terms(docs, id_col, text_col, grams)
    n = docs.select(id_col).distinct().count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if most_terms is not None:
        df = df.orderBy(F.desc("total"), "term").limit(most_terms)
    idf = df.select("term", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").select(id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    # a partition is one document's distinct terms
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / length).alias("weight"))


#: Terms of most documents whose weights every task is sent; postings of the others move to their term's.
COMMON_TERMS = 10_000


def tfidf_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, grams: int = 2) -> DataFrame:
    """The rows of tfidf() whose term is among wanted (term); lengths are those of whole documents.

    Texts move once, to their id; counts are written by document. Of what is
    joined to terms' weights only rare terms' postings move, and of lengths one
    sum a task and document.
    """
    work = Workspace(docs.sparkSession, "tfidf")
    texts = docs.select(id_col, text_col).repartition(id_col)
    counts = work.save(terms(texts, id_col, text_col, grams), "counts")
    n = docs.select(id_col).distinct().count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = work.save(df.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    common = work.save(idf.orderBy(F.desc("df"), "term").limit(COMMON_TERMS).select("term", "idf"), "common")
    weighed = lambda rows: rows.select(id_col, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    often = weighed(counts.join(F.broadcast(common), "term"))
    rare = weighed(counts.join(F.broadcast(common.select("term")), "term", "left_anti").join(idf.select("term", "idf").hint("merge"), "term"))
    squares = lambda rows: rows.groupBy(id_col).agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    lengths = squares(often).unionByName(squares(rare)).groupBy(id_col).agg(F.sqrt(F.sum("s")).alias("length"))
    held = often.unionByName(rare).join(wanted.select("term").distinct(), "term", "left_semi")
    # a null id is a document of its own
    joined = held.withColumnRenamed(id_col, "__id").join(lengths.hint("merge"), F.col("__id").eqNullSafe(F.col(id_col)))
    return joined.select(id_col, "term", (F.col("w") / F.col("length")).alias("weight"))


def recall(index: DataFrame, queries: DataFrame, id_col: str, query_id: str, query_text: str, k: int, allowed: DataFrame | None = None, grams: int = 2, places: int = 9) -> DataFrame:
    """query, id, score, rank: the k documents of greatest summed weight of the query's terms.

    Scores are rounded to ``places`` before they are ranked. ``allowed`` (id)
    limits the documents before the best are chosen. Queries are few; the index
    stays distributed.
    """
    asked = terms(queries, query_id, query_text, grams).select(F.col(query_id).alias("query"), "term", "tf")
    rows = index.join(allowed.select(id_col), id_col, "left_semi") if allowed is not None else index
    # a document's postings are fewer than its pairs with queries, which are added up and cut to the best where they are made
    scores = rows.repartition(id_col).join(F.broadcast(asked), "term").groupBy("query", id_col).agg(F.round(F.sum(F.col("weight") * (1 + F.log("tf"))), places).alias("score"))
    return top_per(scores, ["query"], [F.desc("score"), F.col(id_col)], k)


def relevant_chunks(chunks: DataFrame, species: Column | str, id_col: str, text_col: str, least: float = 0.3, k: int = 6) -> DataFrame:
    """Per species the k chunks of best relevance; of chunks that start alike the best one."""
    name = F.col(species) if isinstance(species, str) else species
    scored = chunks.withColumn("species", name).withColumn("score", text.chunk_relevance(text_col, name)).where(F.col("score") >= least)
    once = top_per(scored.withColumn("__start", F.substring(text_col, 1, 120)), ["species", "__start"], [F.desc("score"), F.col(id_col)], 1, "__r")
    return top_per(once, ["species"], [F.desc("score"), F.col(id_col)], k).drop("__start", "__r")


def name_search(df: DataFrame, query: str, name: str, k: int = 50) -> DataFrame:
    """Names that hold the query, letter case aside; the k first."""
    return df.where(F.contains(F.lower(blank(name)), F.lit(query.lower()))).orderBy(name).limit(k)


def closest_names(df: DataFrame, query: str, name: str, least: float = 70.0, k: int = 10) -> DataFrame:
    """Names by how little has to be edited to reach the query."""
    longest = F.greatest(F.length(name), F.lit(len(query)))
    score = 100.0 * (1 - F.levenshtein(F.lower(F.col(name)), F.lit(query.lower())) / longest)
    return df.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).orderBy(F.desc("score"), name).limit(k)


def best_year(df: DataFrame, group: list[str], year: str, wanted: int | None, k: int) -> DataFrame:
    """The k rows per group nearest to a year, or latest if none is wanted."""
    score = F.col(year).cast("double") if wanted is None else 1.0 / (1 + F.abs(F.col(year) - wanted))
    return top_per(df.withColumn("score", score), group, [F.desc("score"), F.desc(year)], k)


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def margin(probabilities: Column) -> Column:
    """Difference of the two greatest."""
    p = F.sort_array(probabilities, asc=False)
    return F.get(p, F.lit(0)) - F.get(p, F.lit(1))


def most_uncertain(df: DataFrame, confidence: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(confidence, tie).limit(n)


def latest_examples(df: DataFrame, order: str, limit: int, seed: int = 0) -> DataFrame:
    """The latest rows, in a shuffled order that the seed fixes."""
    return df.orderBy(F.desc(order)).limit(limit).orderBy(F.xxhash64(order, F.lit(seed)))


def latest_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's last row."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def distinct_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values, ordered without regard to case."""
    return df.select(F.col(column)).where(blank(column) != "").distinct().orderBy(F.lower(column), column)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_vectors(df: DataFrame, query: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """The k vectors most similar to the one of a table of one row (query), by cosine to nine places."""
    rows = df.join(F.broadcast(query.select(F.col("query").alias("__q")).limit(1)), F.lit(True))
    return rows.withColumn("score", F.round(cosine(F.col(vector), F.col("__q")), 9)).drop("__q").orderBy(F.desc("score"), id_col).limit(k)


def label_vote(near: DataFrame, query: str, label: str) -> DataFrame:
    """The most frequent label among a query's neighbours, and its share."""
    votes = near.groupBy(query, label).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(query).agg(F.max_by(label, F.struct("n", -F.col(label))).alias("label"), (F.max("n") / F.sum("n")).alias("share"))


def joined_within(df: DataFrame, group: list[str], order: list, text_col: str, most: int, separator: str = "\n\n") -> DataFrame:
    """Texts of a group in order, joined, as far as the budget lasts."""
    size = F.length(F.col(text_col))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = df.withColumn("__b", before).where(F.col("__b") + size <= most).withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return kept.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", text_col))), lambda s: s[text_col]), separator).alias("text"), F.count(F.lit(1)).alias("n"))


def flush_buckets(df: DataFrame, group: list[str], order: list, size: Column, most_size: int, most_rows: int) -> DataFrame:
    """df with the bucket each row falls into when a buffer is emptied by rows and by running size."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows, total = F.row_number().over(w) - 1, F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("bucket", F.greatest(F.floor(rows / most_rows), F.floor(total / most_size)).cast("int"))
