"""Queries for the reading operators: text of the query and, beside it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiver.engine import Engine
from quiver.queries.graphs import trade_graph

#: name -> (query, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    # -- scans ------------------------------------------------------------
    "flagship": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS segment, count(*) AS orders, math.round(avg(o.o_totalprice), 4) AS avg_price ORDER BY segment",
        "SELECT c_mktsegment AS segment, count(*) AS orders, round(avg(o_totalprice), 4) AS avg_price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "scan_argument": ("RETURN 1 AS one", "SELECT CAST(1 AS BIGINT) AS one"),
    "scan_all_nodes": (
        "MATCH (n) RETURN count(n) AS n",
        "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) + (SELECT count(DISTINCT user_id) FROM events) AS n",
    ),
    "scan_label": ("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name AS name, c.c_acctbal AS bal", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer"),
    "scan_label_or": (
        "MATCH (n:Customer|Supplier) RETURN labels(n)[0] AS label, count(*) AS n",
        "SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier",
    ),
    "scan_label_and": ("MATCH (n:Customer:Supplier) RETURN count(*) AS n", "SELECT CAST(0 AS BIGINT) AS n"),
    "scan_property": ("MATCH (c:Customer {c_mktsegment: 'BUILDING'}) RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "scan_property_range": ("MATCH (o:Order) WHERE o.o_totalprice >= 1000 AND o.o_totalprice < 50000 RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000"),
    "scan_text": (
        "MATCH (p:Part) WHERE p.p_name STARTS WITH 'P' OR p.p_name ENDS WITH '7' OR p.p_type CONTAINS 'BRASS' RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'P') OR suffix(p_name, '7') OR contains(p_type, 'BRASS')",
    ),
    "scan_point": (
        "MATCH (p:Part) WHERE geo.distance(point({x: p.p_size, y: p.p_retailprice}), point({x: 25, y: 1000})) <= 300 AND geo.within_bbox(point({x: p.p_size, y: p.p_retailprice}), point({x: 0, y: 0}), point({x: 40, y: 1200})) RETURN p.p_partkey AS k",
        "SELECT p_partkey AS k FROM part WHERE sqrt(pow(p_size - 25, 2) + pow(p_retailprice - 1000, 2)) <= 300 AND p_size BETWEEN 0 AND 40 AND p_retailprice BETWEEN 0 AND 1200",
    ),
    "scan_rel_range": (
        "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity >= 45 RETURN id(l) AS l, id(o) AS o, id(p) AS p",
        "SELECT l_orderkey * 10 + l_linenumber AS l, l_orderkey AS o, l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 45",
    ),
    "scan_rel_text": (
        "MATCH ()-[l:CONTAINS]->() WHERE l.l_returnflag STARTS WITH 'R' RETURN l.l_linestatus AS s, count(*) AS n",
        "SELECT l_linestatus AS s, count(*) AS n FROM lineitem WHERE starts_with(l_returnflag, 'R') GROUP BY 1",
    ),
    "scan_rel_point": (
        "MATCH ()-[l:CONTAINS]->() WHERE geo.distance(point({x: l.l_quantity, y: l.l_discount}), point({x: 10, y: 0})) <= 5 RETURN count(*) AS n",
        "SELECT count(*) AS n FROM lineitem WHERE sqrt(pow(l_quantity - 10, 2) + pow(l_discount, 2)) <= 5",
    ),
    # -- patterns ---------------------------------------------------------
    "expand_out": (
        "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_custkey AS c, o.o_orderkey AS o, o.o_orderstatus AS s",
        "SELECT c_custkey AS c, o_orderkey AS o, o_orderstatus AS s FROM customer JOIN orders ON o_custkey = c_custkey",
    ),
    "expand_in": (
        "MATCH (p:Part)<-[l:CONTAINS]-(o:Order) WHERE p.p_size = 1 RETURN p.p_partkey AS p, o.o_orderkey AS o, l.l_linenumber AS n",
        "SELECT p_partkey AS p, o_orderkey AS o, l_linenumber AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size = 1",
    ),
    "expand_both": (
        "MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.n_name AS n, r.r_name AS r",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey",
    ),
    "expand_types": (
        "MATCH (o:Order)<-[r:PLACED|SUPPLIED]-(x) RETURN type(r) AS t, count(*) AS n",
        "SELECT 'PLACED' AS t, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'SUPPLIED', count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey",
    ),
    "expand_rel_props": (
        "MATCH (o:Order)-[l:CONTAINS {l_linenumber: 1, l_returnflag: 'A'}]->(p) RETURN id(o) AS o, id(p) AS p",
        "SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A'",
    ),
    "expand_two_hops": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.p_size < 3 RETURN c.c_mktsegment AS seg, p.p_brand AS brand, math.round(sum(l.l_extendedprice), 2) AS price",
        "SELECT c_mktsegment AS seg, p_brand AS brand, round(sum(l_extendedprice), 2) AS price FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 3 GROUP BY 1, 2",
    ),
    "expand_three_hops": (
        "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region), (s)-[:SUPPLIED]->(o:Order) RETURN r.r_name AS region, count(DISTINCT o) AS orders, count(*) AS items",
        "SELECT r_name AS region, count(DISTINCT l_orderkey) AS orders, count(*) AS items FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    ),
    "varlen_bounded": (
        "MATCH (c:Customer)-[:PLACED|IN_NATION|IN_REGION*1..2]->(x) RETURN c.c_custkey AS c, count(*) AS n",
        "SELECT c, sum(n)::BIGINT AS n FROM (SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey) GROUP BY 1",
    ),
    "varlen_open": (
        "MATCH (s:Supplier)-[:IN_NATION|IN_REGION*]->(r:Region) RETURN s.s_suppkey AS s, r.r_name AS r",
        "SELECT s_suppkey AS s, r_name AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "varlen_zero": (
        "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN n.n_nationkey AS n, count(*) AS c",
        "SELECT n_nationkey AS n, CAST(2 AS BIGINT) AS c FROM nation",
    ),
    "varlen_exact": (
        "MATCH (c:Customer)-[*2]->(r:Region) RETURN r.r_name AS r, count(*) AS n",
        "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "comma_pattern": ("MATCH (a:Region), (b:Nation) RETURN a.r_name AS a, b.n_name AS b", "SELECT r_name AS a, n_name AS b FROM region CROSS JOIN nation"),
    "comma_join": (
        "MATCH (a:Customer), (b:Supplier) WHERE a.c_nationkey = b.s_nationkey AND b.s_acctbal > a.c_acctbal RETURN a.c_custkey AS c, b.s_suppkey AS s",
        "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > c_acctbal",
    ),
    "repeated_variable": (
        "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer), (n)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS n, count(*) AS pairs",
        "SELECT n_name AS n, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "second_match": (
        "MATCH (n:Nation) WHERE n.n_nationkey < 5 MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN n.n_name AS n, c.c_custkey AS c",
        "SELECT n_name AS n, c_custkey AS c FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 5",
    ),
    "bound_relationship": (
        "MATCH (s:Supplier {s_suppkey: 3})-[r:SUPPLIED]->(o) MATCH (x:Supplier)-[r]->(y:Order) WHERE y.o_orderstatus = 'F' RETURN id(r) AS r, x.s_name AS s, y.o_orderkey AS o",
        "SELECT l_orderkey * 10 + l_linenumber AS r, s_name AS s, o_orderkey AS o FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE s_suppkey = 3 AND o_orderstatus = 'F'",
    ),
    "parameter_map": (
        "MATCH (c:Customer $m) RETURN c.c_custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
    ),
    "all_nodes_by_label": (
        "MATCH (n) RETURN labels(n)[0] AS l, count(*) AS n",
        "SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Document', count(*) FROM documents UNION ALL SELECT 'Embedding', count(*) FROM embeddings UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 RETURN c.c_custkey AS c, o.o_orderkey AS o",
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000",
    ),
    "optional_outer_condition": (
        "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > n.n_nationkey * 200 RETURN n.n_name AS n, s.s_name AS s",
        "SELECT n_name AS n, s_name AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 200",
    ),
    "exists": (
        "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' } RETURN c.c_custkey AS c",
        "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    ),
    "not_exists": (
        "MATCH (p:Part) WHERE NOT EXISTS { (p)<-[:CONTAINS]-() } RETURN p.p_partkey AS p",
        "SELECT p_partkey AS p FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
    ),
    "exists_expression": (
        "MATCH (c:Customer) RETURN c.c_custkey AS c, EXISTS { (c)-[:PLACED]->(o) WHERE o.o_totalprice > c.c_acctbal * 30 } AS big",
        "SELECT c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30) AS big FROM customer",
    ),
    "pattern_comprehension": (
        "MATCH (r:Region) RETURN r.r_name AS r, string.join(list.sort([(r)<-[:IN_REGION]-(n) WHERE n.n_nationkey > 3 | n.n_name]), ',') AS nations",
        "SELECT r_name AS r, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 3), '') AS nations FROM region",
    ),
    "exists_in_list": (
        "MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, collect(n) AS ns RETURN r.r_name AS r, size([n IN ns WHERE EXISTS { (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 5000 }]) AS rich, any(n IN ns WHERE EXISTS { (n)<-[:IN_NATION]-(:Customer) }) AS sold",
        "SELECT r_name AS r, count(*) FILTER (EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000))::INT AS rich, bool_or(EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey)) AS sold FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
    "comprehension_in_list": (
        "MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, n ORDER BY n.n_nationkey WITH r, collect(n) AS ns RETURN r.r_name AS r, string.join([n IN ns | toString(size([(n)<-[:IN_NATION]-(s:Supplier) | s.s_suppkey]))], ',') AS suppliers",
        "SELECT r_name AS r, string_agg(k, ',' ORDER BY n_nationkey) AS suppliers FROM (SELECT r_name, n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::VARCHAR AS k FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY 1",
    ),
    "path_build": (
        "MATCH p = (s:Supplier)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN path.first(p).s_name AS s, path.last(p).r_name AS r, path.length(p) AS len, string.join([x IN path.edges(p) | type(x)], '>') AS types",
        "SELECT s_name AS s, r_name AS r, CAST(2 AS BIGINT) AS len, 'IN_NATION>IN_REGION' AS types FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "shortest_path": (
        "MATCH (s:Supplier), (r:Region) MATCH p = shortestPath((s)-[:IN_NATION|IN_REGION*]->(r)) RETURN s.s_suppkey AS s, r.r_name AS r, length(p) AS len",
        "SELECT s_suppkey AS s, r_name AS r, CAST(2 AS BIGINT) AS len FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "all_shortest_paths": (
        "MATCH (s:Supplier), (t:Supplier) WHERE t.s_suppkey <> s.s_suppkey MATCH p = allShortestPaths((s)-[:IN_NATION*..2]-(t)) RETURN s.s_suppkey AS s, t.s_suppkey AS t, count(*) AS n, min(length(p)) AS len",
        "SELECT s.s_suppkey AS s, t.s_suppkey AS t, count(*) AS n, CAST(2 AS BIGINT) AS len FROM supplier s JOIN supplier t ON t.s_nationkey = s.s_nationkey AND t.s_suppkey <> s.s_suppkey JOIN nation ON n_nationkey = s.s_nationkey GROUP BY 1, 2",
    ),
    # -- projection, order, sets ------------------------------------------
    "filter": ("MATCH (o:Order) WHERE o.o_orderpriority IN ['1-URGENT', '2-HIGH'] AND NOT o.o_orderstatus = 'O' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'O'"),
    "projection_star": ("MATCH (r:Region) WITH r.r_name AS name, r.r_regionkey AS k RETURN *", "SELECT r_name AS name, r_regionkey AS k FROM region"),
    "distinct": ("MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "with_having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n, sum(o.o_totalprice) AS total WHERE n > 12 RETURN c.c_name AS name, n, math.round(total, 2) AS total",
        "SELECT c_name AS name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12",
    ),
    "unwind": ("UNWIND [3, 1, null, 2] AS x RETURN x, x * 2 AS y", "SELECT x, x * 2 AS y FROM (SELECT unnest([3, 1, NULL, 2]::BIGINT[]) AS x)"),
    "unwind_collect": (
        "MATCH (n:Nation) WITH n.n_regionkey AS r, collect(n.n_name) AS names UNWIND names AS name RETURN r, name",
        "SELECT n_regionkey AS r, n_name AS name FROM nation",
    ),
    "sort_nulls": (
        "MATCH (d:Document) WITH d ORDER BY d.docket DESC, d.doc_id LIMIT 50 RETURN d.doc_id AS k",
        "SELECT doc_id AS k FROM documents ORDER BY docket DESC NULLS FIRST, doc_id LIMIT 50",
    ),
    "sort_nulls_ascending": (
        "MATCH (d:Document) WITH d ORDER BY d.docket, d.doc_id SKIP 900 LIMIT 300 RETURN d.doc_id AS k",
        "SELECT doc_id AS k FROM documents ORDER BY docket NULLS LAST, doc_id LIMIT 300 OFFSET 900",
    ),
    "top_k": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k LIMIT 10",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10",
    ),
    "skip_limit": ("MATCH (n:Nation) RETURN n.n_name AS n ORDER BY n SKIP 5 LIMIT 7", "SELECT n_name AS n FROM nation ORDER BY n LIMIT 7 OFFSET 5"),
    "union_all": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS n",
        "SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    ),
    "union": (
        "MATCH (c:Customer) RETURN c.c_nationkey AS n UNION MATCH (s:Supplier) RETURN s.s_nationkey AS n",
        "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "call_subquery": (
        "MATCH (n:Nation) CALL { MATCH (n)<-[:IN_NATION]-(c:Customer) WHERE c.c_acctbal > 9000 RETURN count(c) AS rich } RETURN n.n_name AS n, rich",
        "SELECT n_name AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS rich FROM nation",
    ),
    "call_subquery_limit": (
        "MATCH (n:Nation) CALL { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.c_custkey AS best ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 2 } RETURN n.n_name AS n, best",
        "SELECT n_name AS n, best FROM (SELECT n_name, c_custkey AS best, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE rn <= 2",
    ),
    # -- aggregation ------------------------------------------------------
    "agg_count": (
        "MATCH (d:Document) RETURN count(*) AS n, count(d.docket) AS x, count(DISTINCT d.lang) AS y",
        "SELECT count(*) AS n, count(docket) AS x, count(DISTINCT lang) AS y FROM documents",
    ),
    "agg_sum_avg": (
        "MATCH ()-[l:CONTAINS]->() RETURN l.l_returnflag AS f, l.l_linestatus AS s, math.round(sum(l.l_quantity), 2) AS q, math.round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS rev, math.round(avg(l.l_discount), 6) AS d, count(*) AS n",
        "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2",
    ),
    "agg_min_max": (
        "MATCH (o:Order) RETURN o.o_orderstatus AS s, min(o.o_totalprice) AS lo, max(o.o_orderpriority) AS hi",
        "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_orderpriority) AS hi FROM orders GROUP BY 1",
    ),
    "agg_collect": (
        "MATCH (n:Nation) WITH n ORDER BY n.n_name DESC RETURN n.n_regionkey AS r, string.join(collect(n.n_name), ',') AS names",
        "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1",
    ),
    "agg_collect_distinct": (
        "MATCH (o:Order) RETURN o.o_orderpriority AS p, string.join(list.sort(collect(DISTINCT o.o_orderstatus)), '') AS s",
        "SELECT o_orderpriority AS p, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1",
    ),
    "agg_collect_nulls": (
        "MATCH (d:Document) RETURN d.lang AS l, size(collect(d.docket)) AS n",
        "SELECT lang AS l, count(*) AS n FROM documents GROUP BY 1",
    ),
    "agg_stdev": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS m, math.round(stdev(c.c_acctbal), 4) AS a, math.round(stdevp(c.c_acctbal), 4) AS b",
        "SELECT c_mktsegment AS m, round(stddev_samp(c_acctbal), 4) AS a, round(stddev_pop(c_acctbal), 4) AS b FROM customer GROUP BY 1",
    ),
    "agg_percentile_cont": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS m, math.round(percentileCont(c.c_acctbal, 0.3), 4) AS p",
        "SELECT c_mktsegment AS m, round(quantile_cont(c_acctbal, 0.3), 4) AS p FROM customer GROUP BY 1",
    ),
    "agg_percentile_disc": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS m, percentileDisc(c.c_acctbal, 0.3) AS p",
        "SELECT m, max(v) AS p FROM (SELECT c_mktsegment AS m, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE rn = CAST(round(0.3 * (n - 1)) AS BIGINT) + 1 GROUP BY 1",
    ),
    "agg_nested": (
        "MATCH (o:Order) RETURN o.o_orderstatus AS s, count(*) * 2 + 1 AS n, math.round(sum(o.o_totalprice) / count(*), 3) AS mean",
        "SELECT o_orderstatus AS s, count(*) * 2 + 1 AS n, round(sum(o_totalprice) / count(*), 3) AS mean FROM orders GROUP BY 1",
    ),
    "agg_empty": (
        "MATCH (o:Order) WHERE o.o_totalprice < 0 RETURN count(*) AS n, sum(o.o_totalprice) AS s, size(collect(o.o_orderkey)) AS c, stdev(o.o_totalprice) AS d",
        "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS s, CAST(0 AS BIGINT) AS c, CAST(0 AS DOUBLE) AS d",
    ),
    # -- expressions ------------------------------------------------------
    "expr_boolean": (
        "MATCH (d:Document) RETURN d.doc_id AS k, d.lang = 'en' AND d.docket IS NOT NULL AS a, d.lang = 'de' OR d.version_no > 1 AS b, d.lang = 'fr' XOR d.version_no = 1 AS c, NOT d.lang = 'en' AS n",
        "SELECT doc_id AS k, lang = 'en' AND docket IS NOT NULL AS a, lang = 'de' OR version_no > 1 AS b, (lang = 'fr') <> (version_no = 1) AS c, NOT lang = 'en' AS n FROM documents",
    ),
    "expr_compare": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size = 10.0 AS a, p.p_size <> 3 AS b, p.p_size < 7 AS c, p.p_size >= 7 AS d, p.p_name = 5 AS e, p.p_name < 5 AS f",
        "SELECT p_partkey AS k, p_size = 10.0 AS a, p_size <> 3 AS b, p_size < 7 AS c, p_size >= 7 AS d, false AS e, false AS f FROM part",
    ),
    "expr_arithmetic": (
        "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_partkey + p.p_size AS a, p.p_partkey - 7 AS b, p.p_size * 3 AS c, math.round(p.p_partkey / p.p_size, 6) AS d, p.p_partkey % p.p_size AS e, p.p_size ^ 2 AS f, p.p_size / 0 AS g, p.p_size % 0 AS h, -p.p_size AS i",
        "SELECT p_partkey AS k, p_partkey + p_size AS a, p_partkey - 7 AS b, CAST(p_size * 3 AS BIGINT) AS c, round(p_partkey / p_size, 6) AS d, p_partkey % p_size AS e, CAST(p_size AS BIGINT) * p_size AS f, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS BIGINT) AS h, -p_size AS i FROM part",
    ),
    "expr_string": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_name + '/' + c.c_mktsegment AS s, c.c_name =~ 'Customer#0+[1-5].*' AS m, c.c_name CONTAINS '77' AS x",
        "SELECT c_custkey AS k, c_name || '/' || c_mktsegment AS s, regexp_full_match(c_name, 'Customer#0+[1-5].*') AS m, contains(c_name, '77') AS x FROM customer",
    ),
    "expr_case": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS a, CASE WHEN o.o_totalprice > 200000 THEN 2 WHEN o.o_totalprice > 100000 THEN 1 END AS b",
        "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS a, CAST(CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 END AS BIGINT) AS b FROM orders",
    ),
    "expr_list": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_partkey, p.p_size, 7] AS l RETURN k, l[0] AS a, l[-1] AS b, l[9] AS c, size(l[1..]) AS d, 7 IN l AS e, string.join([x IN l WHERE x > 5 | x * 2], ',') AS f, reduce(s = 0, x IN l | s + x) AS g",
        "SELECT p_partkey AS k, p_partkey AS a, CAST(7 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(2 AS BIGINT) AS d, true AS e, array_to_string(list_transform(list_filter([p_partkey, p_size, 7], lambda x: x > 5), lambda x: x * 2), ',') AS f, p_partkey + p_size + 7 AS g FROM part",
    ),
    "expr_quantifiers": (
        "MATCH (p:Part) WITH p.p_partkey AS k, [p.p_size, 10, 20] AS l RETURN k, any(x IN l WHERE x > 40) AS a, all(x IN l WHERE x > 9) AS b, none(x IN l WHERE x = 10) AS c, single(x IN l WHERE x = 20) AS d",
        "SELECT p_partkey AS k, p_size > 40 AS a, p_size > 9 AS b, false AS c, p_size <> 20 AS d FROM part",
    ),
    "expr_map": (
        "MATCH (c:Customer) WITH c{.c_name, .c_acctbal, twice: c.c_acctbal * 2} AS m RETURN m.c_name AS name, m['twice'] AS t, coalesce(m.missing, 'none') AS x",
        "SELECT c_name AS name, c_acctbal * 2 AS t, 'none' AS x FROM customer",
    ),
    "expr_cast": (
        "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_orderkey::STRING AS a, CAST(o.o_totalprice AS INTEGER) AS b, TRY_CAST(o.o_orderstatus AS INTEGER) AS c, (o.o_orderkey AS FLOAT) AS d, toBoolean('TRUE') AS e",
        "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS a, CAST(trunc(o_totalprice) AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(o_orderkey AS DOUBLE) AS d, true AS e FROM orders",
    ),
    "expr_temporal": (
        "MATCH (o:Order) WITH o.o_orderkey AS k, o.o_orderdate AS d RETURN k, d.year AS y, d.month AS m, temporal.get(d, 'day_of_week') AS w, date(temporal.truncate('month', d)) AS t, date(d) + duration('P1M') AS n",
        "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) AS w, CAST(date_trunc('month', o_orderdate) AS DATE) AS t, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS n FROM orders",
    ),
    # -- bigger workloads -------------------------------------------------
    "recommendation": (
        "MATCH (c:Customer {c_custkey: 7})-[:PLACED]->(:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(:Order)<-[:PLACED]-(other:Customer) WHERE other.c_custkey <> 7 RETURN other.c_custkey AS other, count(DISTINCT p) AS shared ORDER BY shared DESC, other LIMIT 20",
        "SELECT o2.o_custkey AS other, count(DISTINCT l1.l_partkey) AS shared FROM orders o1 JOIN lineitem l1 ON l1.l_orderkey = o1.o_orderkey JOIN lineitem l2 ON l2.l_partkey = l1.l_partkey JOIN orders o2 ON o2.o_orderkey = l2.l_orderkey WHERE o1.o_custkey = 7 AND o2.o_custkey <> 7 GROUP BY 1 ORDER BY shared DESC, other LIMIT 20",
    ),
    "trade_volume": (
        "MATCH (rc:Region)<-[:IN_REGION]-(nc:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)<-[l:SUPPLIED]-(s:Supplier)-[:IN_NATION]->(ns:Nation) WHERE rc.r_name = 'ASIA' RETURN nc.n_name AS buyer, ns.n_name AS seller, math.round(sum(l.l_extendedprice), 2) AS volume",
        "SELECT nc.n_name AS buyer, ns.n_name AS seller, round(sum(l_extendedprice), 2) AS volume FROM region JOIN nation nc ON nc.n_regionkey = r_regionkey JOIN customer ON c_nationkey = nc.n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ns ON ns.n_nationkey = s_nationkey WHERE r_name = 'ASIA' GROUP BY 1, 2",
    ),
    "user_events": (
        "MATCH (u:User)-[:DID]->(e:Event) WITH u, e.event_type AS t, count(*) AS n, math.round(sum(e.value), 4) AS v WHERE n > 3 RETURN id(u) AS u, t, n, v",
        "SELECT user_id AS u, event_type AS t, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2 HAVING count(*) > 3",
    ),
    # -- procedures -------------------------------------------------------
    "vector_query_nodes": (
        "CALL db.index.vector.queryNodes('emb', 10, $v) YIELD node, score",
        "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), e)) / 2, 5) AS score FROM embeddings, q ORDER BY (1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), e)) / 2 DESC, vec_id LIMIT 10",
    ),
    "fulltext_query_nodes": (
        "CALL db.index.fulltext.queryNodes('doc_text', 'court valuation') YIELD node, score",
        "WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, len(list_filter(ws, lambda x: x = 'court')) AS a, len(list_filter(ws, lambda x: x = 'valuation')) AS b FROM w) SELECT doc_id, CAST(a + b AS DOUBLE) AS score FROM c WHERE a > 0 AND b > 0",
    ),
}


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = TEXTS[name][0]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        engine = Engine(trade_graph(spark, sf))
        if name == "vector_query_nodes":
            e = spark.read.parquet(f"{sf}/embeddings.parquet")
            v = e.orderBy("vec_id").select("embedding").first()[0]
            return engine.execute(text, {"v": list(v)}).selectExpr("node._id AS vec_id", "round(score, 5) AS score")
        out = engine.execute(text, {"m": {"c_mktsegment": "BUILDING", "c_nationkey": 7}} if name == "parameter_map" else None)
        return out.selectExpr("node._id AS doc_id", "score") if name == "fulltext_query_nodes" else out

    return run


QUERIES = {name: _run(name) for name in TEXTS}
SQL = {name: sql for name, (_, sql) in TEXTS.items()}
