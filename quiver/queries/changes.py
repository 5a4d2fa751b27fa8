"""Queries for updates, catalog commands, files and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiver.engine import Engine
from quiver.graph.mapping import NodeMapping, RelationshipMapping, add_nodes, add_relationships
from quiver.graph.property_graph import EdgeTable, IndexDef, NodeTable, PropertyGraph
from quiver.queries.graphs import trade_graph
from quiver.sources.files import read_csv, read_json_array, read_json_lines, write_csv, write_json_array, write_json_lines
from quiver.streaming.ingest import file_stream, ingest, ingest_csv, run_to_table, windowed_counts
from quiver.workdir import scratch_path


def places(spark: SparkSession, sf: str) -> PropertyGraph:
    """Regions, nations and suppliers: the part of the tables that the updating queries work on."""
    g = trade_graph(spark, sf)
    kept = ("Region", "Nation", "Supplier")
    g = replace(g, nodes=tuple(t for t in g.nodes if t.name in kept), edges=tuple(e for e in g.edges if e.source in kept and e.target in kept), indexes=())
    # line items between suppliers and orders have left with the orders
    return g.as_generic()


#: updates and constraints that run over all tables of the trade graph
WHOLE = ("update_set", "update_delete", "catalog_constraints")

#: name -> (updating or catalog statements, query that reads the outcome, SQL)
STEPS: dict[str, tuple[list[str], str, str]] = {
    "update_create": (
        ["MATCH (r:Region) CREATE (t:Tag {name: r.r_name, even: r.r_regionkey % 2 = 0})-[:OF {w: r.r_regionkey * 10}]->(r)"],
        "MATCH (t:Tag)-[x:OF]->(r:Region) RETURN t.name AS t, t.even AS e, x.w AS w, r.r_regionkey AS r",
        "SELECT r_name AS t, r_regionkey % 2 = 0 AS e, r_regionkey::BIGINT * 10 AS w, r_regionkey AS r FROM region",
    ),
    "update_merge": (
        ["MATCH (n:Nation) MERGE (g:Block {k: n.n_regionkey}) ON CREATE SET g.made = true ON MATCH SET g.made = false", "MATCH (n:Nation), (g:Block) WHERE g.k = n.n_regionkey MERGE (n)-[:IN_BLOCK]->(g)", "MATCH (n:Nation)-[:IN_REGION]->(r) MERGE (g:Block {k: n.n_regionkey}) ON MATCH SET g.seen = 1 MERGE (n)-[:IN_BLOCK]->(g)"],
        "MATCH (n:Nation)-[:IN_BLOCK]->(g:Block) RETURN g.k AS k, g.made AS made, g.seen AS seen, count(n) AS n",
        "SELECT n_regionkey AS k, true AS made, CAST(1 AS BIGINT) AS seen, count(*) AS n FROM nation GROUP BY 1",
    ),
    "update_set": (
        ["MATCH (s:Supplier) WHERE s.s_acctbal < 0 SET s.s_acctbal = 0.0, s.poor = true", "MATCH (s:Supplier {poor: true}) SET s += {note: 'x', poor: null}"],
        "MATCH (s:Supplier) RETURN s.s_suppkey AS k, s.s_acctbal AS b, s.note AS n, s.poor AS p",
        "SELECT s_suppkey AS k, greatest(s_acctbal, 0) AS b, CASE WHEN s_acctbal < 0 THEN 'x' END AS n, CAST(NULL AS BOOLEAN) AS p FROM supplier",
    ),
    "update_set_replace": (
        ["MATCH (r:Region) SET r = {only: r.r_name}"],
        "MATCH (r:Region) RETURN r.only AS o, r.r_regionkey AS k",
        "SELECT r_name AS o, CAST(NULL AS INT) AS k FROM region",
    ),
    "update_labels": (
        ["MATCH (n:Nation) WHERE n.n_regionkey = 1 SET n:Western:Old", "MATCH (n:Western) WHERE n.n_nationkey > 2 REMOVE n:Old"],
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, string.join(list.sort(labels(n)), ',') AS l",
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey <> 1 THEN 'Nation' WHEN n_nationkey > 2 THEN 'Nation,Western' ELSE 'Nation,Old,Western' END AS l FROM nation",
    ),
    "update_remove": (
        ["MATCH (n:Nation) WHERE n.n_nationkey % 2 = 0 REMOVE n.n_name"],
        "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS n",
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 <> 0 THEN n_name END AS n FROM nation",
    ),
    "update_delete": (
        ["MATCH (n:Nation)-[r:IN_REGION]->(x) WHERE x.r_regionkey = 0 DELETE r"],
        "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r) RETURN n.n_nationkey AS k, r.r_name AS r",
        "SELECT n_nationkey AS k, r_name AS r FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 0",
    ),
    "update_detach_delete": (
        ["MATCH (r:Region) WHERE r.r_regionkey > 2 DETACH DELETE r"],
        "MATCH (n) OPTIONAL MATCH (n)-[x]->(m) RETURN labels(n)[0] AS l, count(DISTINCT n) AS n, count(x) AS x",
        "SELECT 'Region' AS l, count(*) AS n, CAST(0 AS BIGINT) AS x FROM region WHERE r_regionkey <= 2 UNION ALL SELECT 'Nation', count(*), count(*) FILTER (n_regionkey <= 2) FROM nation UNION ALL SELECT 'Supplier', count(*), count(*) FROM supplier",
    ),
    "update_foreach": (
        ["MATCH (r:Region) FOREACH (i IN list.range(1, r.r_regionkey) | CREATE (:Mark {of: r.r_name, i: i}))"],
        "MATCH (m:Mark) RETURN m.of AS r, count(*) AS n, sum(m.i) AS s",
        "SELECT r_name AS r, CAST(r_regionkey AS BIGINT) AS n, CAST(r_regionkey * (r_regionkey + 1) // 2 AS BIGINT) AS s FROM region WHERE r_regionkey > 0",
    ),
    "catalog_indexes": (
        ["CREATE INDEX a FOR (n:Nation) ON (n.n_name)", "CREATE TEXT INDEX b IF NOT EXISTS FOR (n:Nation) ON (n.n_name)", "CREATE POINT INDEX c FOR ()-[r:IN_REGION]-() ON (r.p)", "CREATE LOOKUP INDEX d FOR (n) ON EACH labels(n)", "CREATE VECTOR INDEX e FOR (n:Nation) ON (n.v) OPTIONS {indexConfig: {`vector.dimensions`: 3}}", "CREATE FULLTEXT INDEX f FOR (n:Nation|Region) ON EACH [n.n_name, n.r_name]", "DROP INDEX b", "DROP INDEX zz IF EXISTS"],
        "SHOW INDEXES YIELD name, type, entityType WHERE type <> 'POINT' RETURN name, type, entityType ORDER BY name",
        "SELECT * FROM (VALUES ('a', 'RANGE', 'NODE'), ('d', 'LOOKUP', 'NODE'), ('e', 'VECTOR', 'NODE'), ('f', 'FULLTEXT', 'NODE')) t(name, type, \"entityType\")",
    ),
    "catalog_constraints": (
        ["CREATE CONSTRAINT u FOR (n:Nation) REQUIRE n.n_nationkey IS UNIQUE", "CREATE CONSTRAINT k FOR (n:Supplier) REQUIRE (n.s_suppkey, n.s_name) IS NODE KEY", "CREATE CONSTRAINT e FOR (r:Region) REQUIRE r.r_name IS NOT NULL", "CREATE CONSTRAINT t FOR (n:Nation) REQUIRE n.n_name IS :: STRING", "DROP CONSTRAINT e"],
        "SHOW CONSTRAINTS YIELD name, type",
        "SELECT * FROM (VALUES ('u', 'UNIQUE'), ('k', 'KEY'), ('t', 'TYPE')) t(name, type)",
    ),
}


def _steps(name: str):
    changes, read, _ = STEPS[name]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = Engine(trade_graph(spark, sf).as_generic() if name in WHOLE else places(spark, sf))
        for text in changes:
            engine.execute(text)
        return engine.execute(read)

    return run


def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes have which degree, over all relationship types."""
    return trade_graph(spark, sf).degree().groupBy("table", "degree").agg(F.count(F.lit(1)).alias("n"))


def graph_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """The whole trade graph written as Parquet and a manifest, and read again."""
    path = scratch_path(spark, "saved")
    trade_graph(spark, sf).as_generic().save(path)
    return Engine(PropertyGraph.load(spark, path)).execute("MATCH (s:Supplier)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN s.s_name AS s, n.n_name AS n, r.r_name AS r")


def files_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Customers through CSV files with typed headers."""
    path = scratch_path(spark, "csv")
    write_csv(spark.read.parquet(f"{sf}/customer.parquet"), path)
    return read_csv(spark, path)[0]


def files_csv_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents through CSV files: texts with line breaks and quotes, local times, dates."""
    path = scratch_path(spark, "csv")
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "decided_on", "loaded_at", "docket")
    write_csv(df, path)
    rows, _ = read_csv(spark, path)
    return rows.select("doc_id", F.md5("text").alias("text"), "decided_on", "loaded_at", "docket")


def files_csv_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Raw import lines of a layout as files with its header, taken in as a stream: typed rows, and rejected ones by reason."""
    path, target = scratch_path(spark, "csv"), scratch_path(spark, "csv-rows")
    lines = spark.read.parquet(f"{sf}/events.parquet").selectExpr("concat_ws(',', event_id, if(event_id % 7 = 0, 'soon', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")), if(event_id % 11 = 0, 'a\"b', event_type)) AS `id:long,at:localdatetime,kind:string`")
    lines.write.option("quote", "").csv(path, header=True, sep="\t", quote="")
    ingest_csv(spark, path, target, scratch_path(spark, "csv-checkpoint"))
    good = spark.read.parquet(f"{target}/rows").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    bad = spark.read.parquet(f"{target}/rejected").groupBy(F.concat(F.lit("bad "), "reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("timestamp_ntz").alias("last"))
    return good.unionByName(bad)


def some_parts(spark: SparkSession, sf: str) -> PropertyGraph:
    """The trade graph without the parts of size 25 or more, so that line items point at parts that aren't there."""
    g = trade_graph(spark, sf)
    return replace(g, nodes=tuple(replace(t, df=t.df.filter("p_size < 25")) if t.name == "Part" else t for t in g.nodes), known={})


def dangling_ends(spark: SparkSession, sf: str) -> DataFrame:
    """A relationship without its end never matches, whether or not anything of the end is returned."""
    engine = Engine(some_parts(spark, sf))
    texts = (
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN 'key' AS q, p.p_partkey AS p, count(*) AS n",
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part) RETURN 'property' AS q, p.p_partkey AS p, count(p.p_name) AS n",
        "MATCH (p:Part)<-[:CONTAINS]-() RETURN 'first' AS q, id(p) AS p, count(*) AS n",
        "MATCH (o:Order)-[:CONTAINS*1..2]->(p) RETURN 'walk' AS q, id(p) AS p, count(*) AS n",
    )
    frames = [engine.execute(t) for t in texts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def dangling_count(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(some_parts(spark, sf)).execute("MATCH ()-[l:CONTAINS]->() RETURN l.l_returnflag AS f, count(*) AS n")


def files_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path, df = scratch_path(spark, "jsonl"), spark.read.parquet(f"{sf}/part.parquet")
    write_json_lines(df, path)
    return read_json_lines(spark, path, df.schema)


def files_json_array(spark: SparkSession, sf: str) -> DataFrame:
    path, df = scratch_path(spark, "json"), spark.read.parquet(f"{sf}/supplier.parquet")
    write_json_array(df, path)
    return read_json_array(spark, path, df.schema)


def mapping_import(spark: SparkSession, sf: str) -> DataFrame:
    """Rows mapped to nodes by a key, and to relationships by properties of their ends."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    g = add_nodes(PropertyGraph(spark), read("nation"), NodeMapping("Country", "n_nationkey", {"n_name": "name", "n_nationkey": "code"}))
    g = add_nodes(g, read("customer"), NodeMapping("Buyer", "c_custkey", {"c_name": "name", "c_custkey": "number"}))
    g = add_relationships(g, read("customer"), RelationshipMapping("FROM", "Buyer", "number", "c_custkey", "Country", "code", "c_nationkey", {"c_acctbal": "balance"}))
    return Engine(g).execute("MATCH (b:Buyer)-[f:FROM]->(c:Country) RETURN b.name AS b, c.name AS c, f.balance AS bal")


def stream_import(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as a stream, appended as relationships in micro-batches, then counted."""
    path = f"{sf}/events.parquet"
    target = scratch_path(spark, "stream")
    stream = file_stream(spark, path, spark.read.parquet(path).schema)
    ingest(stream, target, scratch_path(spark, "stream-checkpoint"), lambda df: df.selectExpr("event_id AS _id", "user_id AS _src", "event_id AS _dst", "event_type", "value"))
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour and type by event time; the windows that are complete ten minutes behind the newest event."""
    path = f"{sf}/events.parquet"
    stream = file_stream(spark, path, spark.read.parquet(path).schema)
    out = run_to_table(windowed_counts(stream, "ts", ["event_type"], "1 hour", "10 minutes"), "windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def vector_query_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """The relationships nearest to a vector, by squared distance."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    nodes = (NodeTable("Group", e.select("label").distinct(), "label", ("Group",)), NodeTable("Embedding", e, "vec_id", ("Embedding",)))
    index = IndexDef("rv", "VECTOR", "RELATIONSHIP", ("HAS",), ("embedding",), {"similarity": "euclidean"})
    g = PropertyGraph(spark, nodes, (EdgeTable("HAS", e, "vec_id", "label", "vec_id", "Group", "Embedding"),), indexes=(index,))
    v = list(e.orderBy("vec_id").select("embedding").first()[0])
    out = Engine(g).execute("CALL db.index.vector.queryRelationships('rv', 10, $v) YIELD relationship, score", {"v": v})
    return out.selectExpr("relationship._id AS vec_id", "relationship._src AS label", "round(score, 5) AS score")


def fulltext_query_relationships(spark: SparkSession, sf: str) -> DataFrame:
    g = replace(trade_graph(spark, sf), indexes=(IndexDef("rf", "FULLTEXT", "RELATIONSHIP", ("CONTAINS",), ("l_returnflag", "l_linestatus")),))
    return Engine(g).execute("CALL db.index.fulltext.queryRelationships('rf', 'r f')").selectExpr("relationship._id AS k", "score")


def fulltext_index(spark: SparkSession, sf: str) -> DataFrame:
    """An inverted index over all documents, and two searches that read only their words' part of it."""
    engine = Engine(replace(trade_graph(spark, sf), indexes=()))
    engine.execute("CREATE FULLTEXT INDEX texts FOR (d:Document) ON EACH [d.text]")
    found = [engine.execute(f"CALL db.index.fulltext.queryNodes('texts', '{w}')").selectExpr(f"'{w}' AS words", "node._id AS doc_id", "score") for w in ("court valuation", "Gericht")]
    return found[0].unionByName(found[1])


def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return trade_graph(spark, sf).neighbours("Nation", "in").groupBy("id", "table").agg(F.count(F.lit(1)).alias("n"))


def result_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Rows fetched through a cursor, one partition at a time."""
    columns, rows = Engine(trade_graph(spark, sf)).stream("MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.n_name AS n, r.r_name AS r")
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in columns))


QUERIES = {name: _steps(name) for name in STEPS} | {
    "vector_query_relationships": vector_query_relationships, "fulltext_query_relationships": fulltext_query_relationships, "fulltext_index": fulltext_index, "graph_neighbours": graph_neighbours, "result_stream": result_stream,
    "graph_degree": graph_degree, "graph_save_load": graph_save_load, "files_csv": files_csv, "files_csv_breaks": files_csv_breaks, "files_csv_rejected": files_csv_rejected, "dangling_ends": dangling_ends, "dangling_count": dangling_count, "files_json_lines": files_json_lines,
    "files_json_array": files_json_array, "mapping_import": mapping_import, "stream_import": stream_import, "stream_windows": stream_windows,
}

SQL = {name: sql for name, (_, _, sql) in STEPS.items()} | {
    "vector_query_relationships": """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  d AS (SELECT vec_id, label, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings, q)
SELECT vec_id, label, round(1 / (1 + d), 5) AS score FROM d ORDER BY d, vec_id LIMIT 10""",
    "fulltext_query_relationships": "SELECT l_orderkey * 10 + l_linenumber AS k, CAST(2 AS DOUBLE) AS score FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'",
    "fulltext_index": """
WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
  c AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'court')) AS a, len(list_filter(ws, lambda x: x = 'valuation')) AS b, len(list_filter(ws, lambda x: x = 'gericht')) AS g FROM w)
SELECT 'court valuation' AS words, doc_id, CAST(a + b AS DOUBLE) AS score FROM c WHERE a > 0 AND b > 0
UNION ALL SELECT 'Gericht', doc_id, CAST(g AS DOUBLE) FROM c WHERE g > 0""",
    "graph_neighbours": "SELECT n_nationkey::BIGINT AS id, 'Customer' AS \"table\", count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_nationkey, 'Supplier', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "result_stream": "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey",
    "graph_degree": """
WITH d AS (
  SELECT 'Customer' AS t, o_custkey AS k FROM orders UNION ALL SELECT 'Order', o_orderkey FROM orders
  UNION ALL SELECT 'Order', l_orderkey FROM lineitem UNION ALL SELECT 'Part', l_partkey FROM lineitem
  UNION ALL SELECT 'Supplier', l_suppkey FROM lineitem UNION ALL SELECT 'Order', l_orderkey FROM lineitem
  UNION ALL SELECT 'Customer', c_custkey FROM customer UNION ALL SELECT 'Nation', c_nationkey FROM customer
  UNION ALL SELECT 'Supplier', s_suppkey FROM supplier UNION ALL SELECT 'Nation', s_nationkey FROM supplier
  UNION ALL SELECT 'Nation', n_nationkey FROM nation UNION ALL SELECT 'Region', n_regionkey FROM nation
  UNION ALL SELECT 'User', user_id FROM events UNION ALL SELECT 'Event', event_id FROM events)
SELECT t AS "table", degree, count(*) AS n FROM (SELECT t, k, count(*) AS degree FROM d GROUP BY 1, 2) GROUP BY 1, 2""",
    "graph_save_load": "SELECT s_name AS s, n_name AS n, r_name AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    "files_csv": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "files_csv_breaks": "SELECT doc_id, md5(nullif(text, '')) AS text, decided_on, loaded_at, nullif(docket, '') AS docket FROM documents",
    "files_csv_rejected": """
WITH e AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'bad quoting' WHEN event_id % 7 = 0 THEN 'bad value' ELSE event_type END AS kind, date_trunc('second', ts) AS seen FROM events)
SELECT kind, count(*) AS n, max(CASE WHEN kind NOT LIKE 'bad %' THEN seen END) AS last FROM e GROUP BY 1""",
    "dangling_ends": """
WITH p AS (SELECT l_partkey AS p, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 25 GROUP BY 1)
SELECT q, p, n FROM p, (VALUES ('key'), ('property'), ('first'), ('walk')) t(q)""",
    "dangling_count": "SELECT l_returnflag AS f, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 25 GROUP BY 1",
    "files_json_lines": "SELECT * FROM part",
    "files_json_array": "SELECT * FROM supplier",
    "mapping_import": "SELECT c_name AS b, n_name AS c, c_acctbal AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey",
    "stream_import": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
}
