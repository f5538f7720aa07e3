"""Named queries over the supplied tables, one or more for each kind of operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import citations, coords, jsonfix, keys, names, places, text
from fieldloom.operators import annotate, articles, communities, dedup, feedback, filters, graph, lookup, nearest, reconcile, retrieval, segment, similarity, spatial, summaries, tables, upserts
from fieldloom.plans.views import OCCURRENCE_SQL, SEQ, SEQ_SQL, occurrence_view
from fieldloom.session import Workspace, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with DuckDB SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def occ_sql(body: str, more: str = "") -> str:
    return f"WITH {OCCURRENCE_SQL}{', ' + more if more else ''} {body}"


def seq_struct() -> Column:
    return F.struct(*SEQ)


# ---------------------------------------------------------------- dedup and summaries

_DEDUP_SQL = f"""best AS (
    SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY lower(validName), lower(verbatimLocality) ORDER BY
        CASE occurrenceType WHEN 'Primary' THEN 0 WHEN 'Secondary' THEN 1 ELSE 2 END, evidence DESC, {SEQ_SQL}) = 1)"""
_KEPT = ["validName", "verbatimLocality", "occurrenceType", "doc_id", "line", "evidence"]


@query(occ_sql(f"SELECT {', '.join(_KEPT)} FROM best", _DEDUP_SQL))
def dedup_primary(spark, sf_dir):
    """Dedup stages 1 and 2: best type, then most evidence, then first."""
    # only what orders, keys or is kept is sent
    occ = occurrence_view(spark, sf_dir).select(*dict.fromkeys([*_KEPT, "recordedName", *SEQ]))
    return dedup.dedup_records(occ, SEQ, F.col("evidence")).select(*_KEPT)


_REGION = "CASE WHEN part % 3 = 0 THEN 'India' ELSE verbatimLocality END"
_REGIONAL_SQL = f"""r AS (SELECT recordedName, verbatimLocality AS place, doc_id, line, evidence, {_REGION} AS loc FROM occ),
    placed AS (SELECT DISTINCT lower(recordedName) AS k FROM r WHERE lower(loc) <> 'india')"""


@query(occ_sql("SELECT recordedName, loc AS verbatimLocality, doc_id, line, evidence FROM r WHERE NOT (lower(loc) = 'india' AND lower(recordedName) IN (SELECT k FROM placed))", _REGIONAL_SQL))
def dedup_regional(spark, sf_dir):
    """Dedup stage 3: records at a region go where the species has a place."""
    occ = occurrence_view(spark, sf_dir).withColumn("validName", F.col("recordedName"))
    loc = F.when(F.col("part") % 3 == 0, "India").otherwise(F.col("verbatimLocality"))
    return dedup.suppress_regional(occ.withColumn("verbatimLocality", loc)).select("recordedName", "verbatimLocality", "doc_id", "line", "evidence")


_CHECK_FIELDS = ["phylum", "order_", "family_"]


def _atoms(occ: DataFrame) -> DataFrame:
    return occ.select(F.col("validName").alias("valid_name"), F.col("verbatimLocality").alias("locality"), F.col("discount").alias("confidence"), *_CHECK_FIELDS, *[c for c in SEQ if c != "discount"])


_CHECK_SQL = occ_sql(
    f"""SELECT a.valid_name, b.phylum, b.order_, b.family_, n_records, n_localities, max_confidence FROM
        (SELECT validName AS valid_name, count(*) AS n_records, count(DISTINCT verbatimLocality) AS n_localities, max(discount) AS max_confidence FROM occ GROUP BY 1) a
        JOIN (SELECT validName AS valid_name, phylum, order_, family_ FROM occ QUALIFY row_number() OVER (PARTITION BY validName ORDER BY discount DESC, {SEQ_SQL}) = 1) b USING (valid_name)"""
)


@query(_CHECK_SQL)
def species_checklist(spark, sf_dir):
    """Species checklist with the fields of the most confident record."""
    seq = F.struct(*[F.col("confidence") if c == "discount" else F.col(c) for c in SEQ])
    return summaries.checklist(_atoms(occurrence_view(spark, sf_dir)), _CHECK_FIELDS, seq)


@query(
    occ_sql(
        f"""SELECT validName AS valid_name, b.family_, count(*) AS n_records, count(DISTINCT verbatimLocality) AS n_localities, max(evidence) AS max_confidence
            FROM best b GROUP BY validName, b.family_""",
        _DEDUP_SQL,
    )
)
def flagship_checklist(spark, sf_dir):
    """Scan, join, dedup stages 1 to 3, checklist."""
    # written once: both sides of the next stage's join read it, and neither runs the dedup again
    occ = occurrence_view(spark, sf_dir).select("validName", "recordedName", "verbatimLocality", "occurrenceType", "family_", *SEQ)
    kept = dedup.dedup_records(occ, SEQ, F.col("evidence")).drop("occurrenceType")
    records = dedup.suppress_regional(Workspace(spark, "flagship").save(kept, "kept"))
    atoms = records.select(F.col("validName").alias("valid_name"), F.col("verbatimLocality").alias("locality"), F.col("evidence").alias("confidence"), "family_", *[c for c in SEQ if c != "evidence"])
    return summaries.checklist(atoms, ["family_"], F.struct("doc_id", "line"))


@query(occ_sql("SELECT lower(validName) AS species, lower(verbatimLocality) AS locality, count(*) AS n_records, string_agg(DISTINCT lower(occurrenceType), ',' ORDER BY lower(occurrenceType)) AS types FROM occ GROUP BY 1, 2 HAVING count(DISTINCT occurrenceType) > 1"))
def type_conflicts(spark, sf_dir):
    """Contradictory types of one species at one locality."""
    return dedup.conflicts(occurrence_view(spark, sf_dir)).withColumn("types", F.array_join("types", ","))


@query(occ_sql("SELECT doc_id, line, part, evidence, CASE WHEN occurrenceType = 'Primary' AND year < 1994 THEN 'Secondary' ELSE occurrenceType END AS occurrenceType, CASE WHEN occurrenceType = 'Primary' AND year < 1994 THEN 'older_year' END AS rule FROM occ"))
def reconcile_older_year(spark, sf_dir):
    """Reconciliation: evidence of an older year turns primary records secondary."""
    occ = occurrence_view(spark, sf_dir).withColumn("rawTextEvidence", F.concat(F.lit("collected in "), F.col("year").cast("string")))
    return reconcile.reconcile_types(occ, F.lit("Doe et al., 1995")).select("doc_id", "line", "part", "evidence", "occurrenceType", "rule")


@query(
    """WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status, o_totalprice FROM orders)
       SELECT f.field, f.n_filled, n_total, round(100.0 * f.n_filled / n_total, 2) AS pct FROM (SELECT count(*) AS n_total,
         [{'field': 'priority', 'n_filled': count(priority)}, {'field': 'status', 'n_filled': count(status)}, {'field': 'o_totalprice', 'n_filled': count(o_totalprice)}] AS fs FROM o), unnest(fs) AS u(f)"""
)
def completeness_audit(spark, sf_dir):
    """How many rows have each field filled."""
    o = read_table(spark, sf_dir, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), "o_totalprice")
    return summaries.completeness_audit(o, ["priority", "status", "o_totalprice"])


@query(occ_sql("SELECT count(DISTINCT validName) AS validName, count(DISTINCT family_) AS family_, count(DISTINCT verbatimLocality) AS verbatimLocality, count(DISTINCT doc_id) AS doc_id FROM occ"))
def bank_stats(spark, sf_dir):
    """Distinct values of a bank's fields."""
    return summaries.distinct_counts(occurrence_view(spark, sf_dir), ["validName", "family_", "verbatimLocality", "doc_id"])


@query(occ_sql("SELECT phylum, count(*) AS n_records, count(DISTINCT family_) AS n_family_, count(DISTINCT verbatimLocality) AS n_verbatimLocality, array_to_string(list_sort(list(DISTINCT family_))[1:10], ', ') AS family__list, array_to_string(list_sort(list(DISTINCT verbatimLocality))[1:10], ', ') AS verbatimLocality_list FROM occ GROUP BY phylum"))
def session_counts(spark, sf_dir):
    """Session summary: counts and sorted distinct lists."""
    return summaries.session_summary(occurrence_view(spark, sf_dir), "phylum", ["family_", "verbatimLocality"])


@query("SELECT region, c_mktsegment AS segment, count(*) AS n FROM (SELECT n_regionkey::VARCHAR AS region, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY ROLLUP (region, c_mktsegment)")
def section_counts(spark, sf_dir):
    """Group counts with totals."""
    c = read_table(spark, sf_dir, "customer").join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return summaries.group_counts(c.select(F.col("n_regionkey").cast("string").alias("region"), F.col("c_mktsegment").alias("segment")), ["region", "segment"], total=True)


@query(occ_sql("SELECT validName, min(depth_m) AS lat_min, max(depth_m) AS lat_max, min(evidence) AS lon_min, max(evidence) AS lon_max, count(*) AS n FROM occ GROUP BY validName"))
def species_bbox(spark, sf_dir):
    """Box and count per species."""
    return summaries.bounding_boxes(occurrence_view(spark, sf_dir), ["validName"], "depth_m", "evidence")


@query(occ_sql("SELECT validName, min(depth_m) AS lat_min, max(depth_m) AS lat_max, min(evidence) AS lon_min, max(evidence) AS lon_max, count(*) AS n FROM occ GROUP BY validName"))
def species_bbox_incremental(spark, sf_dir):
    """Boxes of two halves grown together equal those of the whole."""
    occ = occurrence_view(spark, sf_dir)
    box = lambda df: summaries.bounding_boxes(df, ["validName"], "depth_m", "evidence")
    return summaries.grow_boxes(box(occ.where("doc_id % 2 = 0")), box(occ.where("doc_id % 2 = 1")), ["validName"])


@query("SELECT s_nationkey AS district, min(s_acctbal) - 0.1 AS lat_min, max(s_acctbal) + 0.1 AS lat_max, min(s_suppkey) - 0.1::DOUBLE AS lon_min, max(s_suppkey) + 0.1::DOUBLE AS lon_max, count(*) AS n FROM supplier GROUP BY 1")
def district_bbox(spark, sf_dir):
    """District boxes with a margin."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("district"), "s_acctbal", F.col("s_suppkey").cast("double").alias("key"))
    return summaries.bounding_boxes(s, ["district"], "s_acctbal", "key", 0.1)


@query(
    occ_sql("""SELECT recordedName, min(year) AS first_year, max(year) AS last_year, min(year) FILTER (occurrenceType = 'Primary') AS first_primary,
               min(year) FILTER (occurrenceType <> 'Primary') AS first_secondary, count(DISTINCT (year, occurrenceType = 'Primary'))::INTEGER AS n_years FROM occ GROUP BY recordedName""")
)
def temporal_index(spark, sf_dir):
    """First and last years by role, from sampling events told as JSON."""
    occ = occurrence_view(spark, sf_dir)
    event = F.concat(F.lit('{"date": "'), F.col("year").cast("string"), F.lit('-06-01"}'))
    return summaries.temporal_index(occ, "recordedName", event, F.lit(""), F.col("occurrenceType")).withColumn("years", F.size("years")).withColumnRenamed("years", "n_years")


@query(occ_sql("SELECT recordedName, year, 'sampling' AS kind, count(*) AS n FROM occ GROUP BY 1, 2 UNION ALL SELECT recordedName, (1990 + doc_id % 9)::INTEGER, 'publication', count(*) FROM occ GROUP BY 1, 2"))
def species_timeline(spark, sf_dir):
    """Sampling and publication entries per year."""
    occ = occurrence_view(spark, sf_dir)
    cited = F.concat(F.lit("Doe; Roe "), (1990 + F.col("doc_id") % 9).cast("string"), F.lit(". A checklist"))
    return summaries.timeline(occ, "recordedName", F.col("year"), citations.publication_year(cited))


@query(occ_sql("SELECT validName, CASE WHEN bool_or(occurrenceType = 'Primary') THEN 'primary' ELSE 'secondary' END AS role FROM occ GROUP BY validName"))
def occurrence_roles(spark, sf_dir):
    """Role of a species: primary if any record is."""
    return summaries.occurrence_role(occurrence_view(spark, sf_dir), "validName", "occurrenceType")


@query(occ_sql("SELECT verbatimLocality AS locality, count(DISTINCT recordedName)::INTEGER AS n_species FROM occ GROUP BY 1"))
def locality_articles(spark, sf_dir):
    """Locality articles: how many species each lists."""
    occ = occurrence_view(spark, sf_dir).withColumns({"validName": F.col("recordedName"), "decimalLatitude": F.col("depth_m"), "decimalLongitude": F.col("depth_m")})
    return articles.locality_articles(occ, "doc_id").select("locality", "n_species")


@query(occ_sql("SELECT recordedName AS species, count(*) AS n_records, count(DISTINCT verbatimLocality)::INTEGER AS n_localities, bool_or(occurrenceType = 'Primary') AS has_primary, array_to_string(list_sort(list(DISTINCT verbatimLocality))[1:3], ', ') AS some FROM occ GROUP BY 1"))
def species_articles(spark, sf_dir):
    """Species articles: aggregated fields."""
    occ = occurrence_view(spark, sf_dir).withColumns({"validName": F.col("recordedName"), "class_": F.lit(None).cast("string"), "habitat": F.lit(None).cast("string"), "decimalLatitude": F.lit(None).cast("double"), "decimalLongitude": F.lit(None).cast("double")})
    a = articles.lead_sentence(articles.species_articles(occ, "doc_id"))
    return a.select("species", "n_records", F.size("localities").alias("n_localities"), "has_primary", F.array_join(F.slice("localities", 1, 3), ", ").alias("some"))


@query(occ_sql("SELECT recordedName, 'Recorded at depths of ' || min(depth_m) || ' to ' || max(depth_m) || ' m.' AS sentence FROM occ GROUP BY 1"))
def depth_sentences(spark, sf_dir):
    """Depth range of each species as a sentence."""
    return articles.depth_sentence(occurrence_view(spark, sf_dir), "recordedName", "depth_m")


@query(occ_sql("SELECT recordedName AS species, 'Region ' || phylum || ', ' || family_ AS region, string_agg(DISTINCT verbatimLocality, '; ' ORDER BY verbatimLocality) AS localities, count(*) AS n FROM occ GROUP BY recordedName, phylum, family_"))
def distribution_sections(spark, sf_dir):
    """Distribution of a species by region."""
    occ = occurrence_view(spark, sf_dir).withColumn("country", F.concat(F.lit("Region "), "phylum"))
    return summaries.distribution(occ, "recordedName", "country", "family_", "verbatimLocality").withColumnRenamed("recordedName", "species")


# ---------------------------------------------------------------- graph

_SLUG = lambda x: f"regexp_replace(lower(trim({x})), '[^a-z0-9_]', '_', 'g')[1:80]"
_NODE = lambda kind, x: f"'{kind.lower()}::' || {_SLUG(x)}"
_NODES_SQL = " UNION ALL ".join(f"SELECT {_NODE(k, c)} AS id, '{k}' AS type, {c} AS label FROM occ" for k, c in (("Species", "validName"), ("Family", "family_"), ("Order", "order_"), ("Phylum", "phylum"), ("Locality", "verbatimLocality"), ("Paper", "sourceCitation")))
_EDGE_LIST = (("Species", "validName", "BELONGS_TO", "Family", "family_"), ("Family", "family_", "BELONGS_TO", "Order", "order_"), ("Order", "order_", "BELONGS_TO", "Phylum", "phylum"), ("Species", "validName", "FOUND_AT", "Locality", "verbatimLocality"), ("Species", "validName", "CITED_BY", "Paper", "sourceCitation"))
_EDGES_SQL = " UNION ALL ".join(f"SELECT {_NODE(a, x)} AS src, '{r}' AS rel, {_NODE(b, y)} AS dst FROM occ" for a, x, r, b, y in _EDGE_LIST)
_N = f"n AS (SELECT id, type, min(label) AS label, count(*) AS n FROM ({_NODES_SQL}) GROUP BY id, type)"
_E = f"e AS (SELECT src, rel, dst, count(*) AS weight FROM ({_EDGES_SQL}) GROUP BY src, rel, dst)"
_DEG = "d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)"


def _graph(spark, sf_dir):
    occ = occurrence_view(spark, sf_dir)
    return graph.nodes(occ), graph.edges(occ)


@query(occ_sql("SELECT id, type, label, n FROM n", _N))
def graph_nodes(spark, sf_dir):
    """Typed nodes that records name."""
    return graph.nodes(occurrence_view(spark, sf_dir))


@query(occ_sql("SELECT src, rel, dst, weight FROM e", _E))
def graph_edges(spark, sf_dir):
    """Typed edges with weights."""
    return graph.edges(occurrence_view(spark, sf_dir))


@query(occ_sql("SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 10", f"{_E}, {_DEG}"))
def graph_degree_top(spark, sf_dir):
    """The ten nodes of most edges."""
    return graph.top_degree(graph.edges(occurrence_view(spark, sf_dir)))


@query(occ_sql("SELECT n_nodes, n_edges, n_pairs, round(2.0::DOUBLE * n_pairs / (n_nodes * (n_nodes - 1)), 9) AS density FROM (SELECT count(*) AS n_nodes FROM n), (SELECT count(*) AS n_edges, count(DISTINCT (least(src, dst), greatest(src, dst))) AS n_pairs FROM e)", f"{_N}, {_E}"))
def graph_density(spark, sf_dir):
    """Nodes, edges and density."""
    return graph.statistics(*_graph(spark, sf_dir))


@query(occ_sql("SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY rel", f"{_N}, {_E}"))
def graph_type_counts(spark, sf_dir):
    """Nodes by type, edges by relation."""
    return graph.type_counts(*_graph(spark, sf_dir))


@query("WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS weight FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2) SELECT a, b, weight FROM p UNION ALL SELECT b, a, weight FROM p")
def cooccurrence_pairs(spark, sf_dir):
    """Parts that orders share, both ways."""
    return graph.co_occurrences(read_table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey")


@query(occ_sql("SELECT src AS id, rel, dst, label, weight FROM (SELECT e.*, n.label, row_number() OVER (PARTITION BY src ORDER BY weight DESC, rel, dst) AS r FROM e JOIN n ON n.id = e.dst WHERE src IN (SELECT id FROM n WHERE type = 'Family')) WHERE r <= 3", f"{_N}, {_E}"))
def neighbourhood_context(spark, sf_dir):
    """The strongest out-edges of families."""
    n, e = _graph(spark, sf_dir)
    # seeds and labels both read the nodes
    n = Workspace(spark, "neighbourhood").save(n, "nodes")
    return graph.neighbours(e, n, n.where("type = 'Family'"), 3)


@query(occ_sql("SELECT src, rel, dst, weight FROM e WHERE src IN (SELECT id FROM d ORDER BY degree DESC, id LIMIT 60) AND dst IN (SELECT id FROM d ORDER BY degree DESC, id LIMIT 60)", f"{_E}, {_DEG}"))
def graph_drawing(spark, sf_dir):
    """The subgraph among the nodes of most edges."""
    n, e = _graph(spark, sf_dir)
    return graph.drawing(n, e, 60)[1]


@query(occ_sql(f"SELECT label FROM n WHERE type = 'Species' AND id IN (SELECT src FROM e WHERE rel = 'BELONGS_TO' AND dst = 'family::brand_12')", f"{_N}, {_E}"))
def family_members(spark, sf_dir):
    """Species of one family."""
    return graph.family_species(*_graph(spark, sf_dir), "Brand#12")


@query()
def graph_communities(spark, sf_dir):
    """Communities of the whole graph by modularity; community_quality holds them against the tables."""
    return communities.communities(graph.edges(occurrence_view(spark, sf_dir)))


@query(occ_sql("SELECT count(*) AS n_nodes, any_value(w.weight) AS weight, TRUE AS one_each, TRUE AS above_propagation, TRUE AS above_types FROM (SELECT src AS id FROM e UNION SELECT dst FROM e), (SELECT sum(weight)::DOUBLE AS weight FROM e) w", _E))
def community_quality(spark, sf_dir):
    """Nodes and weight that communities cover, and that their modularity is at least that of label propagation and of node types."""
    # all are scored on the nodes' places in order, which tie as their names do
    named, own = communities.numbered_communities(graph.edges(occurrence_view(spark, sf_dir)))
    pairs, ids = named.select("a", "b", "weight"), own.select("id", "name")
    kinds = ids.select("id", F.split_part("name", F.lit("::"), F.lit(1)).alias("community"))
    spread = graph.communities(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), 3)
    score = lambda labels, name: communities.modularity(pairs, labels).withColumnRenamed("modularity", name)
    counts = own.agg(F.count(F.lit(1)).alias("n_nodes"), (F.count_distinct("name") == F.count(F.lit(1))).alias("one_each"))
    whole = pairs.agg(F.sum("weight").alias("weight"))
    row = counts.join(whole).join(score(own, "q")).join(score(spread, "q_spread")).join(score(kinds, "q_kinds"))
    return row.select("n_nodes", "weight", "one_each", (F.col("q") >= F.col("q_spread")).alias("above_propagation"), (F.col("q") >= F.col("q_kinds")).alias("above_types"))


_STARS_SQL = """stars AS (SELECT 'customer ' || c_custkey AS id, 'nation ' || c_nationkey AS hub FROM customer),
    members AS (SELECT id, hub FROM stars UNION SELECT hub, hub FROM stars),
    least AS (SELECT hub, min(id) AS community FROM members GROUP BY hub)"""


def _star_edges(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("src"), F.lit("OF").alias("rel"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("dst"), F.lit(1).cast("long").alias("weight"))


@query(f"WITH {_STARS_SQL} SELECT id, community FROM members JOIN least USING (hub)")
def star_communities(spark, sf_dir):
    """Customers around their nations: parts without an edge between them, whose modularity is largest when each is whole."""
    return communities.communities(_star_edges(spark, sf_dir))


@query(f"WITH {_STARS_SQL} SELECT community, count(*) AS n, count(*) FILTER (id LIKE 'customer%') AS n_species, array_to_string(list_sort(list(id) FILTER (id LIKE 'customer%'))[1:8], '; ') AS keywords FROM members JOIN least USING (hub) GROUP BY community")
def community_keywords(spark, sf_dir):
    """Communities with their size and first labels."""
    told = _star_edges(spark, sf_dir)
    ids = told.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kinds = ids.select("id", F.when(F.col("id").startswith("customer"), "Species").otherwise("Locality").alias("type"), F.col("id").alias("label"))
    return communities.community_table(communities.communities(told), kinds)


# ---------------------------------------------------------------- upserts and versions

_ATOM_ID = "substr(sha1(lower(validName) || '|' || lower(verbatimLocality) || '|' || lower(family_)[1:80]), 1, 16)"
_ATOM_SQL = f"a AS (SELECT {_ATOM_ID} AS atom_id, * FROM occ)"


@query(occ_sql("SELECT atom_id, count(*) AS times_confirmed FROM a GROUP BY atom_id", _ATOM_SQL))
def atom_merge(spark, sf_dir):
    """Memory atoms of two halves merged confirm as often as those of the whole."""
    occ = occurrence_view(spark, sf_dir).withColumns({"atom_id": keys.atom_id("validName", "verbatimLocality", "family_"), "seq": F.struct(*SEQ)})
    rows = occ.select("atom_id", "seq", "validName", "family_", "phylum", F.col("doc_id"))
    fields = ["validName", "family_", "phylum"]
    old = rows.where("doc_id % 2 = 0").groupBy("atom_id").agg(F.min_by(F.struct(*fields), "seq").alias("r"), F.count(F.lit(1)).alias("times_confirmed")).select("atom_id", "r.*", "times_confirmed")
    return upserts.merge_atoms(old, rows.where("doc_id % 2 = 1"), fields)[0].select("atom_id", "times_confirmed")


@query(occ_sql(f"SELECT DISTINCT {_ATOM_ID} AS atom_id, {_NODE('Species', 'validName')} AS node_id FROM occ"))
def atom_ids(spark, sf_dir):
    """Atom and node ids."""
    return occurrence_view(spark, sf_dir).select(keys.atom_id("validName", "verbatimLocality", "family_").alias("atom_id"), keys.node_id("Species", "validName").alias("node_id")).distinct()


@query("SELECT l_suppkey AS src, l_returnflag AS rel, l_partkey AS dst, sum(l_quantity) AS weight, max_by(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS props FROM lineitem GROUP BY 1, 2, 3")
def edge_upsert(spark, sf_dir):
    """Edges of two halves upserted."""
    e = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("props"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("seq"))
    half = F.col("seq.l_orderkey") % 2
    return upserts.upsert_edges(e.where(half == 0), e.where(half == 1)).drop("seq")


@query("WITH m AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (3, 7) THEN 1 ELSE c_nationkey END AS k FROM customer) SELECT k AS dst, count(*) AS weight FROM m GROUP BY k")
def locality_migration(spark, sf_dir):
    """Edges re-pointed by a map of renamed nodes and added up."""
    c = read_table(spark, sf_dir, "customer").select(F.lit("c").alias("src"), F.lit("IN").alias("rel"), F.col("c_nationkey").cast("string").alias("dst"), F.lit(1).alias("weight"), F.lit("").alias("props"), F.col("c_custkey").alias("seq"))
    moves = spark.createDataFrame([("3", "1"), ("7", "1")], "old string, new string")
    return upserts.migrate_nodes(c, moves).select(F.col("dst").cast("int").alias("dst"), "weight")


@query("WITH v AS (SELECT o_custkey AS article, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS version, o_totalprice AS body FROM orders) SELECT article, max(version) AS version, max_by(body, version) AS body FROM v GROUP BY article")
def article_current(spark, sf_dir):
    """Current version of every article."""
    v = summaries.numbered(read_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("article"), F.col("n").alias("version"), F.col("o_totalprice").alias("body"))
    return upserts.current_version(v, ["article"])


@query(
    """WITH v AS (SELECT o_custkey AS article, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS version, o_totalprice AS body, '' AS note FROM orders),
       l AS (SELECT article, max(version) AS m FROM v GROUP BY article)
       SELECT * FROM v UNION ALL SELECT v.article, m + 1, body, 'rollback to ' || version FROM v JOIN l USING (article) WHERE version = 1"""
)
def article_versions(spark, sf_dir):
    """Rollback appends the old body as the newest version."""
    v = summaries.numbered(read_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("article"), F.col("n").alias("version"), F.col("o_totalprice").alias("body"), F.lit("").alias("note"))
    to = v.select("article").distinct().withColumn("version", F.lit(1))
    return upserts.rollback(v, ["article"], to)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 5 = 0 THEN 1.0 ELSE o_totalprice END AS price
       FROM orders WHERE o_orderkey % 11 <> 0"""
)
def corrections_overlay(spark, sf_dir):
    """A log of edits and deletions over a table; the last edit of a field holds."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    log = o.where("o_orderkey % 5 = 0").select("o_orderkey", none.alias("status"), F.lit(1.0).alias("price"), no.alias("gone"), F.lit(1).alias("seq"))
    log = log.unionByName(o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("status"), F.lit(0.0).alias("price"), no.alias("gone"), F.lit(2).alias("seq")))
    log = log.unionByName(o.where("o_orderkey % 11 = 0").select("o_orderkey", none.alias("status"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("gone"), F.lit(3).alias("seq")))
    return upserts.overlay(o, log, ["o_orderkey"], "seq", ["status", "price"], "gone")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def insert_or_ignore(spark, sf_dir):
    """Rows whose key another table lacks."""
    o = read_table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return upserts.insert_new(o, read_table(spark, sf_dir, "customer"), ["c_custkey"]).select("c_custkey", "c_mktsegment")


# ---------------------------------------------------------------- filters and lookups


@query(occ_sql("SELECT doc_id, line, part, evidence FROM occ WHERE phylum IN ('ASIA', 'EUROPE') AND family_ IN ('Brand#12', 'Brand#23', 'Brand#31')"))
def taxon_cascade_filter(spark, sf_dir):
    """Rows of selected taxa."""
    return filters.select_taxa(occurrence_view(spark, sf_dir), {"phylum": ["ASIA", "EUROPE"], "family_": ["Brand#12", "Brand#23", "Brand#31"], "order_": []}).select("doc_id", "line", "part", "evidence")


@query(occ_sql("SELECT DISTINCT family_ FROM occ WHERE phylum = 'ASIA'"))
def taxon_options(spark, sf_dir):
    """Options left under a selection."""
    return retrieval.distinct_options(filters.select_taxa(occurrence_view(spark, sf_dir), {"phylum": ["ASIA"]}), "family_")


@query("SELECT o_orderkey, o_orderstatus, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, c_mktsegment) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_fill_enrichment(spark, sf_dir):
    """Blank fields filled from a reference."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_orderstatus", F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise("").alias("label"))
    ref = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    return lookup.fill_blanks(o, ref, ["key"], ["label"]).drop("key")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def unmatched_names(spark, sf_dir):
    """Distinct keys that a reference lacks."""
    ref = read_table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return lookup.unmatched(read_table(spark, sf_dir, "lineitem"), ref, ["l_partkey"])


@query("SELECT s_nationkey AS query, s_name AS name, s_acctbal AS population FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, s_acctbal DESC, s_name) = 1")
def gazetteer_rank(spark, sf_dir):
    """Best gazetteer hit by feature class, then population."""
    kind = F.element_at(F.array(*map(F.lit, "PAHX")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    hits = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("query"), F.col("s_name").alias("name"), kind.alias("feature_class"), F.col("s_acctbal").alias("population"))
    return lookup.rank_gazetteer(hits, "query").select("query", "name", "population")


@query("SELECT p_partkey AS key, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END) AS value, CASE WHEN p_partkey % 2 = 0 THEN 'even' WHEN p_partkey % 3 = 0 THEN 'third' END AS stage FROM part")
def lookup_cascade(spark, sf_dir):
    """Ordered lookup stages, each over what the one before missed."""
    p = read_table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key")
    return lookup.cascade(p, "key", [("even", p.where("key % 2 = 0").select("key", F.col("p_name").alias("value"))), ("third", p.where("key % 3 = 0").select("key", F.col("p_brand").alias("value")))], ["value"])


def _place_rows(spark, sf_dir):
    t = read_table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return t.select(F.col("p_name").alias("place_name"), (100000 + F.col("k")).cast("string").alias("postal_code"), F.lit("S").alias("state_name"), F.lit("C").alias("county_name"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))


@query("WITH p AS (SELECT DISTINCT p_name FROM part) SELECT query, p_name AS place_name, 'exact' AS match_type, 100.0::DOUBLE AS score FROM (SELECT upper(p_name) || ' (x)' AS query, p_name FROM p)")
def place_exact(spark, sf_dir):
    """Place matching: queries that differ in case and parentheses only match exactly."""
    index = lookup.place_index(_place_rows(spark, sf_dir), ["postal_code"])
    asked = index.select(F.concat(F.upper("place_name"), F.lit(" (x)")).alias("query"))
    return lookup.match_places(asked, "query", index).select("query", "place_name", "match_type", "score")


@query()
def place_stages(spark, sf_dir):
    """Place matching through all stages; no SQL form."""
    index = lookup.place_index(_place_rows(spark, sf_dir), ["postal_code"])
    p = index.select("place_name", "postal_code")
    asked = p.select(F.concat(F.lit("x"), F.col("place_name")).alias("query")).union(p.select(F.concat(F.lit("code "), F.col("postal_code")))).union(p.select(F.replace("place_name", F.lit("a"), F.lit("aa"))))
    return lookup.match_places(asked, "query", index).select("query", "place_name", "match_type", F.round("score", 3).alias("score"))


@query(
    """WITH a AS (SELECT DISTINCT p_name || 'x' AS l FROM part), b AS (SELECT DISTINCT p_name AS r FROM part)
       SELECT l AS left_key, r AS right_key, round(100.0 * (1 - levenshtein(l, r)::DOUBLE / greatest(length(l), length(r))), 6) AS score FROM a, b
       WHERE 100.0 * (1 - levenshtein(l, r)::DOUBLE / greatest(length(l), length(r))) >= 80"""
)
def place_fuzzy(spark, sf_dir):
    """Similarity join by edit distance over shared blocks."""
    p = read_table(spark, sf_dir, "part").select("p_name").distinct()
    asked = p.select(F.concat("p_name", F.lit("x")).alias("asked"))
    return similarity.similar_pairs(asked, p, "asked", "p_name", 80.0, "edit").withColumn("score", F.round("score", 6))


@query("SELECT l_orderkey AS doc_id, min(l_partkey) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 4 OR bool_or(l_returnflag = 'A')")
def silent_chunks(spark, sf_dir):
    """Chunks without a signal are left out of long documents; here: documents that keep one."""
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_returnflag")
    kept = filters.skip_silent_chunks(rows, "doc_id", F.col("l_returnflag") == "A", 4)
    whole = rows.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    return whole.groupBy("doc_id").agg(F.min("l_partkey").alias("n"))


@query("SELECT e.event_id, coalesce(m.event_id, -1) AS near_id FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') m ON m.user_id = e.user_id AND abs(m.event_id - e.event_id) <= 400 WHERE e.event_type = 'click' QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(m.event_id - e.event_id), m.event_id) = 1")
def nearest_mention(spark, sf_dir):
    """Each record's nearest mention within a reach."""
    e = read_table(spark, sf_dir, "events")
    rows = e.where("event_type = 'click'").select("user_id", "event_id")
    told = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("near_id"))
    return nearest.nearest_mention(rows, told, "user_id", "event_id", 400, ["near_id"]).select("event_id", F.coalesce("near_id", F.lit(-1)).alias("near_id"))


# ---------------------------------------------------------------- text


@query("SELECT doc_id, i - 1 AS n, substr(text, 1 + (i - 1) * 400, 500) AS body FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(1, ceil((length(text) - 100) / 400.0))::BIGINT)) AS i FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, sf_dir):
    """Fixed-size chunks with overlap."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(text.windows("text", 500, 100)).alias("n", "body")).withColumn("n", F.col("n").cast("long"))


@query("SELECT doc_id, i - 1 AS n, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)")
def line_split(spark, sf_dir):
    """Lines of documents."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines("text")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


@query("SELECT doc_id, s AS sentence FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))) AS s FROM documents) WHERE length(s) > 10")
def sentence_split(spark, sf_dir):
    """Sentences of more than ten letters."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences("text")).alias("sentence"))


@query()
def hierarchical_levels(spark, sf_dir):
    """Sections, paragraphs and sentences with offsets; no SQL form."""
    return summaries.level_counts(segment.levels(read_table(spark, sf_dir, "documents")), "doc_id")


@query()
def packed_chunks(spark, sf_dir):
    """Chunks with overlap by the strategy that fits a document; no SQL form."""
    return segment.chunk_documents(read_table(spark, sf_dir, "documents"), most=1200, overlap=150).select("doc_id", "n", "start", "stop", "fresh", "strategy")


@query("SELECT conv_id, turn, list_sort(list_distinct(list(role) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)))::VARCHAR AS roles FROM conversations")
def nearby_sentences(spark, sf_dir):
    """What is told within two turns."""
    out = nearest.around(read_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role"), 2, "roles")
    return out.select("conv_id", "turn", F.concat(F.lit("["), F.array_join(F.sort_array("roles"), ", "), F.lit("]")).alias("roles"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]{2,}\\s+[a-z]{3,}'))::INTEGER AS n_names, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}\\s+[a-z]{3,}')))::INTEGER AS n_distinct FROM documents")
def binomial_scan(spark, sf_dir):
    """Two-word names by pattern."""
    found = text.matches("text", r"[A-Z][a-z]{2,}\s+[a-z]{3,}")
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_names"), F.size(F.array_distinct(found)).alias("n_distinct"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(collected|recorded|observed|found|identified|encountered|we collected|specimens were|new record|new occurrence|first report|present study|this study|our survey|examined|deposited in|new species)\\b'))::INTEGER AS n_primary FROM documents")
def signal_counts(spark, sf_dir):
    """Signals of primary records."""
    from fieldloom.functions.vocabulary import PRIMARY_SIGNALS

    return read_table(spark, sf_dir, "documents").select("doc_id", text.count_of("text", PRIMARY_SIGNALS).alias("n_primary"))


@query()
def name_candidates(spark, sf_dir):
    """Name candidates with offsets and context; no SQL form."""
    return annotate.name_candidates(read_table(spark, sf_dir, "documents")).drop("context")


@query()
def text_spans(spark, sf_dir):
    """Annotated spans per document and label; no SQL form."""
    return annotate.spans(read_table(spark, sf_dir, "documents")).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH d AS (SELECT doc_id, text || ' Aus bus was found at ' || CASE doc_id % 3 WHEN 0 THEN 'Okha Reef' WHEN 1 THEN 'Gulf of Kutch' ELSE 'Mandvi' END || '.' AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(*) FILTER (subject = 'Aus bus') AS told, any_value(object) FILTER (subject = 'Aus bus') AS object FROM (
            SELECT doc_id, 'Aus bus' AS subject, regexp_extract(t, 'Aus bus was found at ((?:[A-Z][A-Za-z]+ ?(?:of )?)+)\.$', 1) AS object FROM d) GROUP BY doc_id"""
)
def sentence_relations(spark, sf_dir):
    """Where the sentences of whole texts say that one species was found."""
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL")
    place = F.when(F.col("doc_id") % 3 == 0, "Okha Reef").when(F.col("doc_id") % 3 == 1, "Gulf of Kutch").otherwise("Mandvi")
    told = annotate.relations(docs.select("doc_id", F.concat("text", F.lit(" Aus bus was found at "), place, F.lit(".")).alias("text")))
    mine = told.where("subject = 'Aus bus'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("told"), F.first("object").alias("object"))
    return docs.select("doc_id").join(mine, "doc_id").select("doc_id", "told", "object")


@query()
def table_prose(spark, sf_dir):
    """Tables in texts told as sentences; no SQL form."""
    return tables.detected(read_table(spark, sf_dir, "documents")).select("doc_id", "n", "n_rows", "n_columns", "prose")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf_dir):
    """Titles of pages."""
    return read_table(spark, sf_dir, "pages").select("page_id", text.html_title("html").alias("title"))


@query("SELECT conv_id, turn, length(text)::INTEGER AS n FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 600")
def budget_prefix(spark, sf_dir):
    """Turns of a conversation within a character budget."""
    c = read_table(spark, sf_dir, "conversations")
    return filters.budget_prefix(c, ["conv_id"], ["turn", "role", "text"], F.length("text"), 600).select("conv_id", "turn", F.length("text").alias("n"))


@query("SELECT conv_id, turn, greatest(floor((rn - 1) / 3), floor(b / 500))::INTEGER AS bucket FROM (SELECT *, row_number() OVER w AS rn, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))")
def buffer_flush(spark, sf_dir):
    """Buckets of a buffer that is emptied by rows and size."""
    c = read_table(spark, sf_dir, "conversations")
    return retrieval.flush_buckets(c, ["conv_id"], ["turn", "role", "text"], F.length("text"), 500, 3).select("conv_id", "turn", "bucket")


@query()
def batch_pack(spark, sf_dir):
    """Next-fit packing of turns; no SQL form."""
    c = summaries.numbered(read_table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"]).withColumn("n", F.col("n").cast("long"))
    return segment.batches(c, "conv_id", "n", F.length("text"), 800).select("conv_id", "n", "batch")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """Fields of JSON texts."""
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def json_repair(spark, sf_dir):
    """Cut-off and wrapped replies read; no SQL form."""
    e = read_table(spark, sf_dir, "events")
    reply = F.concat(F.lit("Sure:\n```json\n["), "props", F.lit(", "), "props", F.when(F.col("event_id") % 2 == 0, "").otherwise("]\n```"))
    return e.select("event_id", F.size(jsonfix.json_records(reply)).alias("n"))


# ---------------------------------------------------------------- retrieval, feedback, vectors

_TERM_SQL = """WITH q AS (SELECT doc_id, string_agg(text, '') AS text FROM documents GROUP BY doc_id),
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM q), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM q),
    w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN df USING (term), n),
    u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query(
    _TERM_SQL
    + """, a AS (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark), b AS (SELECT query, term, count(*) AS tf FROM a GROUP BY 1, 2),
    s AS (SELECT query, doc_id, round(sum(weight * (1 + ln(tf))), 6) AS score FROM u JOIN b USING (term) GROUP BY 1, 2)
    SELECT query, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 5"""
)
def tfidf_recall(spark, sf_dir):
    """Documents recalled for each benchmark text by TF-IDF."""
    asked = read_table(spark, sf_dir, "benchmark")
    index = retrieval.tfidf_of(read_table(spark, sf_dir, "documents"), "doc_id", "text", retrieval.terms(asked, "item_id", "text", 1), grams=1)
    return retrieval.recall(index, asked, "doc_id", "item_id", "text", 5, grams=1, places=6).drop("rank")


@query(
    "SELECT doc_id, score FROM (SELECT doc_id, lang, least((CASE WHEN contains(t, 'and the') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, 'the') THEN 0.3 ELSE 0 END + CASE WHEN contains(t, 'and') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(t, 'diagnosis|description|habitat|distribution|material examined') THEN 0.05 ELSE 0 END)::DOUBLE, 1.0) AS score FROM (SELECT *, lower(text) AS t FROM documents)) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 5"
)
def relevance_topk(spark, sf_dir):
    """Most relevant texts per group."""
    d = read_table(spark, sf_dir, "documents").withColumn("score", text.chunk_relevance("text", F.lit("and the")))
    return retrieval.top_per(d, ["lang"], [F.desc("score"), F.col("doc_id")], 5).select("doc_id", "score")


@query("SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 ORDER BY n_chars, doc_id LIMIT 25")
def uncertain_topn(spark, sf_dir):
    """The least sure rows."""
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents"), "doc_id").where("toxic = 0")
    return retrieval.most_uncertain(d, "n_chars", 25, "doc_id").select("doc_id", "quality", "n_chars")


@query(
    """WITH p AS (SELECT quality AS t, (n_chars > 1500)::INTEGER AS s FROM labels JOIN documents USING (doc_id)), l AS (SELECT DISTINCT t AS label FROM p UNION SELECT DISTINCT s FROM p),
       m AS (SELECT label, count(*) FILTER (t = label) AS support, count(*) FILTER (s = label) AS said, count(*) FILTER (t = label AND s = label) AS hit FROM l, p GROUP BY label),
       x AS (SELECT label, support, CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS r FROM m)
       SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x"""
)
def class_metrics(spark, sf_dir):
    """Precision, recall and F1 of each label."""
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents"), "doc_id").withColumn("said", (F.col("n_chars") > 1500).cast("int"))
    return summaries.label_metrics(d, "quality", "said")


@query()
def type_classifier(spark, sf_dir):
    """A classifier of labelled texts and its predictions; no SQL form."""
    d = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    model = feedback.fit_types(d.select("text", "label"))
    return feedback.predict_types(model, d.select("doc_id", "text")).select("doc_id", "predicted", "confidence", "needs_review")


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 15")
def vector_topk(spark, sf_dir):
    """Vectors most similar to one."""
    e = read_table(spark, sf_dir, "embeddings")
    query = e.agg(F.min_by("embedding", "vec_id").alias("query"))
    return retrieval.nearest_vectors(e, query, "vec_id", "embedding", 15).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda e, x: 0.3::DOUBLE * x + 0.7::DOUBLE * e), 6) AS ema, count(*)::INTEGER AS n FROM events WHERE value IS NOT NULL GROUP BY user_id")
def ema_duration(spark, sf_dir):
    """Moving average of each user's values."""
    e = read_table(spark, sf_dir, "events")
    return summaries.moving_average(e, ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"), "n")


@query("WITH s AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END) AS r FROM events GROUP BY 1) SELECT CASE r WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'purchase' END AS stage, count(*) AS n FROM s WHERE r > 0 GROUP BY 1")
def stage_counts(spark, sf_dir):
    """Users by the furthest stage they reached."""
    e = read_table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase")).withColumnRenamed("event_type", "stage")
    return summaries.stage_counts(e, "user_id", ["view", "click", "purchase"])


# ---------------------------------------------------------------- places and coordinates

_LAT, _LON = "(s_suppkey * 37 % 300) / 10.0", "60 + (s_suppkey * 53 % 400) / 10.0"


def _points(spark, sf_dir):
    k = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 300 / 10.0).alias("lat"), (60 + k * 53 % 400 / 10.0).alias("lon"))


@query(
    f"""WITH p AS (SELECT s_suppkey AS id, {_LAT} AS lat, {_LON} AS lon FROM supplier),
        m AS (SELECT a.id, b.id AS near, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM p a, p b)
        SELECT id, near, round(km, 4) AS km, row_number() OVER (PARTITION BY id ORDER BY round(km, 6), near)::INTEGER AS nth FROM m WHERE km <= 120 QUALIFY nth <= 3"""
)
def nearest_places(spark, sf_dir):
    """The three nearest places within a reach, by grid cells."""
    p = _points(spark, sf_dir)
    places_ = p.select(F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), F.col("id").alias("near"))
    out = spatial.nearest_places(p, places_.select("near", "place_lat", "place_lon"), ["id"], "lat", "lon", 40, 120.0)
    ranked = retrieval.top_per(out.withColumn("r", F.round("km", 6)).drop("nth"), ["id"], [F.col("r"), F.col("near")], 3, "nth")
    return ranked.select("id", "near", F.round("km", 4).alias("km"), "nth")


@query(f"WITH p AS (SELECT s_suppkey AS id, {_LAT} AS lat, {_LON} AS lon FROM supplier) SELECT id, n_nationkey AS cell FROM p JOIN nation ON lat > n_nationkey AND lat < n_nationkey + 3 AND lon > 60 + n_nationkey AND lon < 66 + n_nationkey")
def points_in_polygons(spark, sf_dir):
    """Points inside polygons, by grid cells and ray casting."""
    k = F.col("n_nationkey")
    corner = lambda y, x: F.struct((k + y + F.lit(0.0)).alias("y"), (k + x + F.lit(0.0)).alias("x"))
    polygons = read_table(spark, sf_dir, "nation").select(F.array(corner(0, 60), corner(3, 60), corner(3, 66), corner(0, 66)).alias("ring"), k.alias("cell"))
    inside = spatial.points_in_polygons(_points(spark, sf_dir), polygons, "lat", "lon")
    return inside.where((F.col("lat") > F.col("cell")) & (F.col("lon") > 60 + F.col("cell"))).select("id", "cell")


@query(f"SELECT s_suppkey AS id, CASE WHEN NOT ({_LAT} BETWEEN 6.0 AND 37.6 AND {_LON} BETWEEN 68.0 AND 97.5) THEN 'outside' ELSE 'inside' END AS home FROM supplier")
def country_box(spark, sf_dir):
    """Points inside the country's box."""
    from fieldloom.functions.vocabulary import COUNTRY_BOX

    return _points(spark, sf_dir).select("id", F.when(coords.in_box(F.col("lat"), F.col("lon"), COUNTRY_BOX), "inside").otherwise("outside").alias("home"))


@query("SELECT s_suppkey AS id, round((s_suppkey % 80) + (s_suppkey % 60) / 60.0 + 30 / 3600.0, 7) * CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END AS degrees FROM supplier")
def read_degrees(spark, sf_dir):
    """Coordinates in degrees, minutes and seconds read as decimals."""
    k = F.col("s_suppkey")
    told = F.format_string("%s %d°%d'30\"", F.when(k % 2 == 0, "S").otherwise("N"), k % 80, k % 60)
    return read_table(spark, sf_dir, "supplier").select(k.alias("id"), coords.parse_degrees(told).alias("degrees"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name_key, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS letters, 'species::' || regexp_replace(lower(trim(p_name)), '[^a-z0-9_]', '_', 'g')[1:80] AS node_id FROM part")
def slug_node_ids(spark, sf_dir):
    """Keys of names."""
    return read_table(spark, sf_dir, "part").select("p_partkey", names.squeeze("p_name").alias("name_key"), names.letters_only("p_name").alias("letters"), keys.node_id("Species", "p_name").alias("node_id"))


@query("SELECT p_partkey, replace(lower(p_name), ' ', '') AS squeezed FROM part")
def canonical_places(spark, sf_dir):
    """Canonical place keys of spelling variants meet; here: of doubled letters."""
    out = places.canonical_place(F.regexp_replace("p_name", "s", "ss"))
    same = out == places.canonical_place("p_name")
    return read_table(spark, sf_dir, "part").select("p_partkey", F.when(same, F.replace(F.lower("p_name"), F.lit(" "), F.lit(""))).alias("squeezed"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def union_of_layers(spark, sf_dir):
    """Layers of differing columns as one table of distinct rows."""
    c = read_table(spark, sf_dir, "customer")
    both = upserts.union_all(c.where("c_acctbal < 0").select("c_custkey", "c_mktsegment", "c_acctbal"), c.where("c_nationkey = 3").select("c_custkey", "c_mktsegment"))
    return both.select("c_custkey", "c_mktsegment").distinct()


@query("SELECT o_custkey, o_orderpriority, count(*) AS votes, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS strategies FROM orders GROUP BY 1, 2")
def vote_merge(spark, sf_dir):
    """Votes per key: strategies and counts."""
    o = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("cust "), F.col("o_custkey").cast("string")).alias("validName"), F.lit("").alias("recordedName"), F.col("o_orderpriority").alias("verbatimLocality"), F.lit("Primary").alias("occurrenceType"), "o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority")
    out = dedup.merge_votes(o, "o_orderstatus", ["o_custkey", "o_orderpriority"], ["o_orderkey"])
    return out.select(F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderpriority", "votes", F.array_join("strategies", ",").alias("strategies"))


@query("SELECT o_custkey, o_clerk, number FROM (SELECT o_custkey, o_orderpriority AS o_clerk, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey), o_orderpriority)::INTEGER AS number FROM orders GROUP BY o_custkey, o_orderpriority)")
def citation_numbers(spark, sf_dir):
    """Citations numbered by first appearance."""
    o = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "o_clerk")
    return dedup.numbered_first_seen(o, ["o_custkey"], "o_clerk", "o_orderkey")


