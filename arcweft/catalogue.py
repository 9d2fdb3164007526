"""The registered graph queries over the relational tables, each with its SQL counterpart.

A query is (text, SQL, options); ``labels`` keeps only those node tables, so that patterns without labels stay
within them.  The flagship is ``hop_count_by_segment``.
"""

from __future__ import annotations

from dataclasses import dataclass

from .sources.tables import table_graph


@dataclass(frozen=True)
class Entry:
    text: str
    sql: str | None = None
    labels: tuple | None = None


#: The graph of a search over all pairs of nodes: places and who is there.
TRADE = ("Region", "Nation", "Customer", "Supplier")
# SQL: how many nodes and edges the whole graph has
_V = "((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events))"
_E = "((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events))"
_PAGERANK = """
WITH RECURSIVE ids AS (
  SELECT 'Region:' || r_regionkey AS id FROM region UNION ALL SELECT 'Nation:' || n_nationkey FROM nation UNION ALL SELECT 'Customer:' || c_custkey FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'Part:' || p_partkey FROM part UNION ALL SELECT 'Order:' || o_orderkey FROM orders UNION ALL SELECT 'Event:' || event_id FROM events),
edges AS (
  SELECT 'Nation:' || n_nationkey AS a, 'Region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier UNION ALL SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders
  UNION ALL SELECT 'Order:' || l_orderkey, 'Part:' || l_partkey FROM lineitem UNION ALL SELECT 'Order:' || l_orderkey, 'Supplier:' || l_suppkey FROM lineitem UNION ALL SELECT 'Customer:' || user_id, 'Event:' || event_id FROM events),
links AS (SELECT a, b, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY a) AS w FROM edges GROUP BY a, b),
start AS (SELECT id, id NOT IN (SELECT a FROM links) AS leaf, count(*) OVER () AS n FROM ids),
ranks AS (
  SELECT 0 AS i, id, leaf, n, 1.0::DOUBLE / n AS score, 1.0::DOUBLE AS moved FROM start
  UNION ALL
  SELECT i + 1, id, leaf, n, new, sum(abs(new - score)) OVER ()
  FROM (SELECT i, id, leaf, n, score, moved, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(gain, 0) + sum(CASE WHEN leaf THEN score ELSE 0 END) OVER () / n) AS new
        FROM ranks LEFT JOIN (SELECT b, sum(score * w) AS gain FROM ranks JOIN links ON id = a GROUP BY b) ON b = id)
  WHERE i < 100 AND moved >= 1e-6)
SELECT CAST(replace(id, 'Customer:', '') AS INT) AS k, CAST(floor(score * 1000000000 + 0.5) AS BIGINT) AS score
FROM ranks WHERE i = (SELECT max(i) FROM ranks) AND id LIKE 'Customer:%'
"""

ENTRIES: dict[str, Entry] = {
    "match_label_where": Entry("MATCH (c:Customer) WHERE c.acctbal > 9000 RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000"),
    "match_all_nodes_count": Entry("MATCH (n) RETURN count(n) AS total", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) AS total"),
    "match_label_or": Entry("MATCH (n:Region|Nation) RETURN id(n) AS k, coalesce(n.name, '') AS name", "SELECT 'Region:' || r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 'Nation:' || n_nationkey, n_name FROM nation"),
    "match_label_not": Entry(
        "MATCH (n:!Event) RETURN labelsOf(n)[0] AS label, count(*) AS c",
        "SELECT 'Region' AS label, count(*) AS c FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders",
    ),
    "match_prop_map": Entry("MATCH (p:Part {brand: 'Brand#13'}) RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_brand = 'Brand#13'"),
    "match_dynamic_prop_map": Entry(
        "MATCH (r:Region) MATCH (n:Nation {regionkey: r.regionkey}) RETURN r.name AS r, count(n) AS c",
        "SELECT r_name AS r, count(*) AS c FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "hop_count_by_segment": Entry(
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 100000 RETURN c.mktsegment AS segment, count(o) AS orders ORDER BY orders DESC",
        "SELECT c_mktsegment AS segment, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "hop_incoming": Entry(
        "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS n, count(s) AS c",
        "SELECT n_name AS n, count(*) AS c FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "hop_undirected": Entry(
        "MATCH (n:Nation)--(x) RETURN n.name AS n, count(*) AS c",
        "SELECT n_name AS n, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS c FROM nation",
    ),
    "hop_type_alternatives": Entry(
        "MATCH (o:Order)-[r:CONTAINS|SUPPLIED_BY]->(x) RETURN type(r) AS t, count(*) AS c",
        "SELECT unnest(['CONTAINS', 'SUPPLIED_BY']) AS t, (SELECT count(*) FROM lineitem) AS c",
    ),
    "multi_hop_region": Entry(
        "MATCH (r:Region)<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o) RETURN r.name AS r, toInteger(sum(o.totalprice) + 0.33505) AS total, count(*) AS orders",
        "SELECT r_name AS r, CAST(floor(sum(o_totalprice) + 0.33505) AS BIGINT) AS total, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "edge_props": Entry(
        "MATCH (:Order)-[l:CONTAINS]->(p:Part) RETURN p.type AS t, sum(l.quantity) AS q",
        "SELECT p_type AS t, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
    "edge_prop_map": Entry(
        "MATCH (o:Order)-[l:CONTAINS {returnflag: 'R', linenumber: 1}]->(p:Part) RETURN count(*) AS c",
        "SELECT count(*) AS c FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1",
    ),
    "optional_match": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) RETURN c.custkey AS k, count(e) AS n",
        "SELECT c_custkey AS k, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1",
    ),
    "optional_match_where": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN c.custkey AS k, o.orderkey AS o",
        "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000",
    ),
    "optional_null_where": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) WHERE e IS NULL RETURN count(c) AS n, count(e) AS e",
        "SELECT count(*) AS n, CAST(0 AS BIGINT) AS e FROM customer",
    ),
    "anti_by_with": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) WITH c, e WHERE e IS NULL RETURN count(c) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
    ),
    "chained_match_bound_target": Entry(
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS n, count(*) AS pairs",
        "SELECT n_name AS n, count(*) AS pairs FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "cyclic_pattern": Entry(
        "MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier), (o:Order)-[:SUPPLIED_BY]->(s), (c)-[:PLACED]->(o) RETURN n.name AS n, count(*) AS c",
        "SELECT n_name AS n, count(*) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    ),
    "revisits_node": Entry(
        "MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b) RETURN a.name AS a, count(b) AS c",
        "SELECT a.n_name AS a, count(*) AS c FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1",
    ),
    "cartesian_theta": Entry(
        "MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey = b.regionkey RETURN a.name AS a, b.name AS b",
        "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    ),
    "not_null_logic": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) WITH c, e WHERE NOT (e.value > 10) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer LEFT JOIN events ON user_id = c_custkey WHERE NOT coalesce(value > 10, false)",
    ),
    "boolean_logic": Entry(
        "MATCH (p:Part) WHERE (p.size > 40 XOR p.retailprice > 1500) AND NOT p.brand IN ['Brand#11', 'Brand#12'] RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE ((p_size > 40) <> (p_retailprice > 1500)) AND p_brand NOT IN ('Brand#11', 'Brand#12')",
    ),
    "string_predicates": Entry(
        "MATCH (p:Part) WHERE p.type STARTS WITH 'P' OR p.type ENDS WITH 'Y' OR p.name CONTAINS '7' RETURN count(*) AS n",
        "SELECT count(*) AS n FROM part WHERE p_type LIKE 'P%' OR p_type LIKE '%Y' OR p_name LIKE '%7%'",
    ),
    "chained_comparison": Entry("MATCH (p:Part) WHERE 10 <= p.size < 20 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size >= 10 AND p_size < 20"),
    "semi_pattern": Entry(
        "MATCH (c:Customer) WHERE size([(c)-[:PLACED]->(o) WHERE o.totalprice > 450000 | 1]) > 0 RETURN c.custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    ),
    "anti_pattern": Entry(
        "MATCH (c:Customer) WHERE size([(c)-[:PLACED]->(o) WHERE o.totalprice > 250000 | 1]) = 0 RETURN c.custkey AS k",
        "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    ),
    "pattern_predicate": Entry(
        "MATCH (c:Customer) WHERE NOT (c)-[:DID]->(:Event) AND (c)-[:PLACED]->() RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) AND c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "pattern_comprehension": Entry(
        "MATCH (n:Nation) RETURN n.name AS n, size([(n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 0 | s.suppkey]) AS c",
        "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS c FROM nation",
    ),
    "pattern_comprehension_outer": Entry(
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH n, r.regionkey * 1000 AS least RETURN n.name AS n, size([(n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > least | 1]) AS c",
        "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > n_regionkey * 1000) AS c FROM nation",
    ),
    "count_pattern": Entry(
        "MATCH (c:Customer) WITH c, count((c)-[:PLACED]->()) AS degree RETURN c.custkey AS k, degree ORDER BY degree DESC, k LIMIT 10",
        "SELECT c_custkey AS k, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY degree DESC, k LIMIT 10",
    ),
    "with_having": Entry(
        "MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 15 RETURN c.custkey AS k, n",
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
    ),
    "with_star": Entry("MATCH (r:Region) WITH * WHERE r.regionkey > 1 RETURN r.name AS n", "SELECT r_name AS n FROM region WHERE r_regionkey > 1"),
    "agg_all": Entry(
        "MATCH (s:Supplier) RETURN count(*) AS n, count(DISTINCT s.nationkey) AS d, toInteger(sum(s.acctbal) + 0.33505) AS s, toInteger(avg(s.acctbal) + 0.33505) AS a, min(s.acctbal) AS lo, max(s.acctbal) AS hi, sum(DISTINCT s.nationkey) AS sd",
        "SELECT count(*) AS n, count(DISTINCT s_nationkey) AS d, CAST(trunc(sum(s_acctbal) + 0.33505) AS BIGINT) AS s, CAST(trunc(avg(s_acctbal) + 0.33505) AS BIGINT) AS a, min(s_acctbal) AS lo, max(s_acctbal) AS hi, CAST(sum(DISTINCT s_nationkey) AS BIGINT) AS sd FROM supplier",
    ),
    "agg_expression": Entry(
        "MATCH (:Order)-[l:CONTAINS]->() RETURN l.returnflag AS f, toInteger(sum(l.extendedprice * (1 - l.discount)) + 0.33505) AS revenue, count(*) * 2 AS twice, toInteger(max(l.quantity) - min(l.quantity)) AS spread",
        "SELECT l_returnflag AS f, CAST(trunc(sum(l_extendedprice * (1 - l_discount)) + 0.33505) AS BIGINT) AS revenue, count(*) * 2 AS twice, CAST(max(l_quantity) - min(l_quantity) AS BIGINT) AS spread FROM lineitem GROUP BY 1",
    ),
    "agg_empty": Entry(
        "MATCH (p:Part) WHERE p.size > 1000 RETURN count(p) AS n, sum(p.size) AS s, avg(p.size) AS a, size(collect(p.name)) AS l",
        "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(NULL AS DOUBLE) AS a, CAST(0 AS BIGINT) AS l",
    ),
    "collect_sorted": Entry(
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, n ORDER BY n.name WITH r.name AS r, collect(n.name) AS names RETURN r, size(names) AS c, reduce(t = 0, x IN names | t + size(x)) AS chars",
        "SELECT r_name AS r, count(*) AS c, CAST(sum(length(n_name)) AS BIGINT) AS chars FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "collect_distinct": Entry(
        "MATCH (c:Customer) RETURN c.mktsegment AS s, size(collect(DISTINCT c.nationkey)) AS nations, size(collect(c.nationkey)) AS customers",
        "SELECT c_mktsegment AS s, count(DISTINCT c_nationkey) AS nations, count(*) AS customers FROM customer GROUP BY 1",
    ),
    "distinct_order_skip_limit": Entry(
        "MATCH (p:Part) RETURN DISTINCT p.size AS size ORDER BY size DESC SKIP 5 LIMIT 10",
        "SELECT DISTINCT p_size AS size FROM part ORDER BY size DESC LIMIT 10 OFFSET 5",
    ),
    "order_by_input": Entry(
        "MATCH (c:Customer) RETURN c.name AS name ORDER BY c.acctbal DESC, c.custkey LIMIT 7",
        "SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7",
    ),
    "nulls_first_last": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 480000 WITH c.custkey AS k, max(o.totalprice) AS m RETURN k, m ORDER BY m, k LIMIT 12",
        "SELECT c_custkey AS k, max(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 480000 GROUP BY 1 ORDER BY m NULLS LAST, k LIMIT 12",
    ),
    "order_by_boolean": Entry(
        "MATCH (n:Nation) RETURN n.name AS n, n.regionkey > 2 AS far ORDER BY far, n LIMIT 11",
        "SELECT n_name AS n, n_regionkey > 2 AS far FROM nation ORDER BY far DESC, n LIMIT 11",
    ),
    "unwind_where": Entry("UNWIND [1, 2, 3, 4, 5] AS x WHERE x > 2 RETURN x AS x, x * x AS sq", "SELECT x, x * x AS sq FROM (SELECT unnest([3, 4, 5])::BIGINT AS x)"),
    "unwind_chars": Entry("UNWIND 'abc' AS c UNWIND [null, 1] AS x RETURN c, x", "SELECT unnest(['a', 'b', 'c', 'a', 'b', 'c']) AS c, unnest([NULL, NULL, NULL, 1, 1, 1])::BIGINT AS x"),
    "union_all_align": Entry(
        "MATCH (r:Region) RETURN r.name AS name, r.regionkey AS region UNION ALL MATCH (n:Nation) RETURN n.name AS name, n.nationkey AS nation",
        "SELECT r_name AS name, r_regionkey AS region, CAST(NULL AS INT) AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation",
    ),
    "union_dedup": Entry(
        "MATCH (c:Customer) RETURN c.nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.nationkey AS k UNION MATCH (n:Nation) RETURN n.nationkey AS k ORDER BY k DESC LIMIT 20",
        "SELECT n_nationkey AS k FROM nation ORDER BY k DESC LIMIT 20",
    ),
    "call_correlated": Entry(
        "MATCH (r:Region) CALL { MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.nationkey > 10 RETURN n.name AS nation } YIELD nation WHERE nation <> '' RETURN r.name AS r, nation",
        "SELECT r_name AS r, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey > 10",
    ),
    "call_correlated_topk": Entry(
        "MATCH (n:Nation) CALL { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN c.custkey AS k ORDER BY c.acctbal DESC, c.custkey LIMIT 2 } RETURN n.name AS n, k",
        "SELECT n_name AS n, c_custkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE r <= 2",
    ),
    "call_aggregate": Entry(
        "MATCH (c:Customer) CALL { MATCH (c)-[:DID]->(e:Event) WHERE e.value > 50 RETURN count(e) AS n, sum(e.event_id) AS s } RETURN c.custkey AS k, n, s",
        "SELECT c_custkey AS k, count(event_id) AS n, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS s FROM customer LEFT JOIN events ON user_id = c_custkey AND value > 50 GROUP BY 1",
    ),
    "call_union": Entry(
        "MATCH (r:Region) CALL { MATCH (r)<-[:IN_REGION]-(n) RETURN n.name AS x UNION ALL RETURN 'none' AS x } RETURN r.name AS r, count(x) AS c",
        "SELECT r_name AS r, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + 1 AS c FROM region",
    ),
    "case_general": Entry(
        "MATCH (c:Customer) RETURN CASE WHEN c.acctbal < 0 THEN 'debt' WHEN c.acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n",
        "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM customer GROUP BY 1",
    ),
    "case_simple": Entry(
        "MATCH (o:Order) RETURN CASE o.orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS s, count(*) AS n",
        "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS s, count(*) AS n FROM orders GROUP BY 1",
    ),
    "arith_null_div0": Entry(
        "MATCH (r:Region) RETURN r.regionkey AS k, 10 / r.regionkey AS d, 10 % r.regionkey AS m, r.regionkey ^ 2 AS p, -r.regionkey + null AS z",
        "SELECT r_regionkey AS k, CASE WHEN r_regionkey <> 0 THEN 10.0::DOUBLE / r_regionkey END AS d, CAST(CASE WHEN r_regionkey <> 0 THEN 10 % r_regionkey END AS BIGINT) AS m, pow(r_regionkey, 2) AS p, CAST(NULL AS DOUBLE) AS z FROM region",
    ),
    "list_ops": Entry(
        "MATCH (r:Region) WITH r, [x IN [1, 2, 3, 4, r.regionkey] WHERE x > 1 | x * 10] AS l RETURN r.regionkey AS k, size(l) AS n, l[0] AS a, l[-1] AS b, size(l[1..3]) AS s, head(l) AS h, last(tail(l)) AS t, 20 IN l AS has",
        "SELECT r_regionkey AS k, len(l) AS n, l[1] AS a, l[-1] AS b, len(l[2:3]) AS s, l[1] AS h, l[-1] AS t, list_contains(l, 20) AS has FROM (SELECT r_regionkey, list_transform(list_filter([1, 2, 3, 4, r_regionkey::BIGINT], lambda x: x > 1), lambda x: x * 10) AS l FROM region)",
    ),
    "quantifiers": Entry(
        "MATCH (n:Nation) WITH n, split(n.name, '') AS cs RETURN n.name AS n, all(c IN cs WHERE c <> 'X') AS a, any(c IN cs WHERE c = '1') AS b, none(c IN cs WHERE c = 'Z') AS d, single(c IN cs WHERE c = 'N') AS e",
        "SELECT n_name AS n, NOT contains(n_name, 'X') AS a, contains(n_name, '1') AS b, NOT contains(n_name, 'Z') AS d, length(n_name) - length(replace(n_name, 'N', '')) = 1 AS e FROM nation",
    ),
    "reduce_list": Entry(
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r.name AS r, collect(n.nationkey) AS ks RETURN r, reduce(t = 0, k IN ks | t + k * k) AS sq",
        "SELECT r_name AS r, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS sq FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "string_funcs": Entry(
        "MATCH (n:Nation) RETURN toLower(n.name) AS lo, toUpper(n.name) AS up, substring(n.name, 1, 3) AS sub, size(split(n.name, 'A')) AS parts, repl(n.name, 'A', '-') AS r, trim('  ' + n.name + ' ') AS t, reverse(n.name) AS rev, length(n.name) AS len",
        "SELECT lower(n_name) AS lo, upper(n_name) AS up, substring(n_name, 2, 2) AS sub, len(string_split(n_name, 'A')) AS parts, replace(n_name, 'A', '-') AS r, n_name AS t, reverse(n_name) AS rev, length(n_name) AS len FROM nation",
    ),
    "conversions": Entry(
        "MATCH (s:Supplier) RETURN s.suppkey AS k, toString(s.nationkey) AS t, toInteger('12abc') AS i, toFloat('3.5x') AS f, toBoolean(s.nationkey) AS b, toInteger(s.acctbal) AS n, toString(2.0) AS d",
        "SELECT s_suppkey AS k, CAST(s_nationkey AS VARCHAR) AS t, CAST(12 AS BIGINT) AS i, 3.5::DOUBLE AS f, s_nationkey <> 0 AS b, CAST(trunc(s_acctbal) AS BIGINT) AS n, '2' AS d FROM supplier",
    ),
    "temporal_parts": Entry(
        "MATCH (o:Order) RETURN year(o.orderdate) AS y, month(o.orderdate) AS m, count(*) AS n",
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "temporal_compare": Entry(
        "MATCH (o:Order) WHERE o.orderdate >= date(1995, 1, 1) AND o.orderdate < '1996-01-01' RETURN count(*) AS n",
        "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
    ),
    "temporal_build": Entry(
        "RETURN date(2023, 13, 1) AS d, datetime({year: 2023, month: 6, day: 15, hour: 14}) AS t, time(14, 30, 45, 120) AS c, localdatetime('2023-01-02T03:04:05') AS l, datetimewithtimezone('2023-06-15T14:30:45+02:00') AS z, duration({hours: 1, minutes: 30}) AS u, totalMinutes('PT1H30M') AS m, epochseconds('1970-01-02') AS e, temporalepoch('1970-01-01T01:00:00+01:00') AS te",
        "SELECT '2024-01-01' AS d, '2023-06-15T14:00:00.000Z' AS t, '14:30:45.120' AS c, '2023-01-02T03:04:05' AS l, '2023-06-15T14:30:45+02:00' AS z, 'PT1H30M' AS u, 90.0::DOUBLE AS m, CAST(86400 AS BIGINT) AS e, CAST(0 AS BIGINT) AS te",
    ),
    "path_value": Entry(
        "MATCH p = (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) WHERE c.custkey < 20 RETURN c.custkey AS k, length(p) AS hops, [x IN nodes(p) | id(x)][2] AS region, size(relationships(p)) AS rels",
        "SELECT c_custkey AS k, CAST(2 AS BIGINT) AS hops, 'Region:' || n_regionkey AS region, CAST(2 AS BIGINT) AS rels FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey < 20",
    ),
    "varlen_region": Entry(
        "MATCH (r:Region)-[*1..2]-(x) RETURN r.name AS r, labelsOf(x)[0] AS label, count(*) AS n",
        "SELECT r_name AS r, 'Nation' AS label, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, 'Supplier', count(*) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT r_name, 'Customer', count(*) FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "varlen_zero": Entry(
        "MATCH (c:Customer)-[rs:IN_NATION|IN_REGION*0..2]->(x) RETURN labelsOf(x)[0] AS label, count(*) AS c, sum(size(rs)) AS hops",
        "SELECT 'Customer' AS label, count(*) AS c, CAST(0 AS BIGINT) AS hops FROM customer UNION ALL SELECT 'Nation', count(*), count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'Region', count(*), 2 * count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "varlen_simple_paths": Entry(
        "MATCH (a:Supplier)-[:IN_NATION*1..2]-(b:Customer) RETURN a.suppkey AS s, count(*) AS paths",
        "SELECT s_suppkey AS s, count(*) AS paths FROM supplier JOIN customer ON c_nationkey = s_nationkey GROUP BY 1",
    ),
    "varlen_limit": Entry(
        "MATCH (a:Customer)-[*1..]->(b:Order) RETURN 'path' AS p LIMIT 12",
        "SELECT 'path' AS p FROM orders LIMIT 12",
    ),
    "varlen_depth_cap": Entry(
        "MATCH (s:Supplier)-[:IN_NATION|IN_REGION*]->(x) RETURN labelsOf(x)[0] AS label, count(*) AS c",
        "SELECT 'Nation' AS label, count(*) AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'Region', count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    ),
    "varlen_self_loop": Entry(
        "MATCH (c:Customer) WHERE c.acctbal < 0 CREATE (c)-[:SELF]->(c) CREATE (c)-[:NEXT]->(:Stop {k: c.custkey}) WITH count(*) AS n MATCH (c:Customer)-[r:SELF|NEXT*1..3]->(y) RETURN n, labelsOf(y)[0] AS label, count(*) AS c, sum(size(r)) AS hops",
        "SELECT count(*) AS n, l AS label, count(*) AS c, count(*) AS hops FROM customer, (SELECT unnest(['Customer', 'Stop']) AS l) WHERE c_acctbal < 0 GROUP BY l",
    ),
    "shortest_path_len": Entry(
        "MATCH (a:Region) MATCH (b:Customer) RETURN b.custkey AS k, a.name AS r, length(shortestPath((b)-[:IN_NATION|IN_REGION*..3]->(a))) AS hops",
        "SELECT c_custkey AS k, r_name AS r, CASE WHEN n_regionkey = r_regionkey THEN 2 END::BIGINT AS hops FROM customer JOIN nation ON n_nationkey = c_nationkey, region",
    ),
    "all_shortest_paths": Entry(
        "MATCH (r:Region) MATCH (s:Supplier) RETURN r.name AS r, s.suppkey AS k, size(allShortestPaths((s)-[*..3]->(r))) AS n",
        "SELECT r_name AS r, s_suppkey AS k, CAST(n_regionkey = r_regionkey AS BIGINT) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey, region",
    ),
    "all_shortest_paths_many": Entry(
        "MATCH (c:Customer) WHERE c.acctbal < -900 MATCH (s:Supplier) RETURN c.custkey AS c, s.suppkey AS s, size(allShortestPaths((c)-[:PLACED|SUPPLIED_BY*..2]->(s))) AS n",
        "SELECT c_custkey AS c, s_suppkey AS s, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_suppkey = s_suppkey) AS n FROM customer, supplier WHERE c_acctbal < -900",
    ),
    "graph_stats": Entry(
        "MATCH (r:Region) RETURN r.name AS r, numNodes() AS nodes, numRelationships() AS rels, density() AS density, averageDegree() AS degree",
        f"SELECT r_name AS r, {_V} AS nodes, {_E} AS rels, CAST({_E} AS DOUBLE) / ({_V} * ({_V} - 1)) AS density, CAST(2 * {_E} AS DOUBLE) / {_V} AS degree FROM region",
    ),
    "diameter": Entry(
        "MATCH (r:Region) RETURN r.name AS r, diameter() AS d",
        "SELECT r_name AS r, CAST(CASE WHEN (SELECT count(*) FROM region) > 1 THEN -1 ELSE 4 END AS BIGINT) AS d FROM region",
        TRADE,
    ),
    "degree_centrality": Entry(
        "MATCH (n:Customer) RETURN n.custkey AS k, degreeCentrality(n) AS score",
        f"SELECT c_custkey AS k, CAST(1 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) + (SELECT count(*) FROM events WHERE user_id = c_custkey) AS DOUBLE) / ({_V} - 1) AS score FROM customer",
    ),
    "score_map": Entry(
        "WITH degreeCentrality() AS scores RETURN size(keys(scores)) AS n, toInteger(scores['Region:0'] * 1000000 + 0.5) AS first",
        f"SELECT {_V} AS n, CAST(floor((SELECT count(*) FROM nation WHERE n_regionkey = 0)::DOUBLE / ({_V} - 1) * 1000000 + 0.5) AS BIGINT) AS first",
    ),
    "betweenness": Entry(
        "MATCH (n:Region|Nation) RETURN id(n) AS k, betweennessCentrality(n) AS score",
        "WITH k AS (SELECT n_nationkey, n_regionkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation), t AS (SELECT n_regionkey AS r, sum(1 + k)::DOUBLE AS total, sum((1 + k) * (1 + k))::DOUBLE AS squares FROM k GROUP BY 1) SELECT 'Region:' || r_regionkey AS k, coalesce((total * total - squares) / 2, 0) AS score FROM region LEFT JOIN t ON r = r_regionkey UNION ALL SELECT 'Nation:' || n_nationkey, k * (k - 1) / 2 + k * (total - k) FROM k JOIN t ON r = n_regionkey",
        TRADE,
    ),
    "pagerank": Entry("MATCH (n:Customer) RETURN n.custkey AS k, toInteger(pagerank(n) * 1000000000 + 0.5) AS score", _PAGERANK),
    "connected_component": Entry(
        "MATCH (n:Nation) WITH n, connectedComponent(n) AS g RETURN n.name AS n, size(g.nodes) AS nodes, size(g.edges) AS edges",
        "WITH k AS (SELECT n_regionkey AS r, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS k FROM nation) SELECT n_name AS n, CAST(1 + (SELECT sum(k) FROM k WHERE r = n_regionkey) AS BIGINT) AS nodes, CAST((SELECT sum(k) FROM k WHERE r = n_regionkey) AS BIGINT) AS edges FROM nation",
        TRADE,
    ),
    "ego_graph": Entry(
        "MATCH (n:Customer) WITH n, egoGraph(n, 1) AS g RETURN n.custkey AS k, size(g.nodes) AS nodes, size(g.edges) AS edges",
        "SELECT c_custkey AS k, 2 + o + e AS nodes, 1 + o + e AS edges FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS o, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS e FROM customer)",
    ),
    "subgraph_of_list": Entry(
        "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, collect(c) AS cs WITH n.name AS n, subgraph([x IN cs | x] + [n]) AS g RETURN n, size(g.nodes) AS nodes, size(g.edges) AS edges",
        "SELECT n_name AS n, 1 + count(*) AS nodes, count(*) AS edges FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "create_set_delete": Entry(
        "MATCH (c:Customer) WHERE c.acctbal < 0 CREATE (c)-[:OWES]->(d:Debt {amount: -c.acctbal}) SET d.fresh = true WITH count(*) AS made MATCH (x:Supplier) WHERE x.acctbal < 5000 DETACH DELETE x WITH DISTINCT made MATCH (n:Nation)<-[:IN_NATION]-(x) OPTIONAL MATCH (x)-[:OWES]->(d) RETURN made, n.name AS n, count(x) AS c, count(x.suppkey) AS suppliers, count(d.fresh) AS fresh",
        "SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS made, n_name AS n, count(*) AS c, count(s) AS suppliers, count(fresh) AS fresh FROM nation JOIN (SELECT c_nationkey AS k, NULL AS s, CASE WHEN c_acctbal < 0 THEN 1 END AS fresh FROM customer UNION ALL SELECT s_nationkey, s_suppkey, NULL FROM supplier WHERE s_acctbal >= 5000) ON k = n_nationkey GROUP BY n_name",
    ),
    "delete_edges": Entry(
        "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice > 200000 DELETE r WITH count(*) AS n MATCH (c:Customer)-[:PLACED]->(o) RETURN n, count(o) AS left",
        'SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS n, (SELECT count(*) FROM orders WHERE o_totalprice <= 200000) AS "left"',
    ),
    "merge": Entry(
        "MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON CREATE SET s.made = true ON MATCH SET s.seen = true WITH count(*) AS n MATCH (s:Segment) RETURN n, s.name AS s, coalesce(s.made, false) AS made, coalesce(s.seen, false) AS seen",
        "SELECT (SELECT count(*) FROM customer) AS n, c_mktsegment AS s, true AS made, false AS seen FROM customer GROUP BY c_mktsegment",
    ),
    "merge_existing": Entry(
        "UNWIND ['ASIA', 'ATLANTIS', 'ATLANTIS'] AS name MERGE (r:Region {name: name}) ON CREATE SET r.made = true ON MATCH SET r.seen = true WITH count(*) AS n MATCH (r:Region) RETURN n, r.name AS r, coalesce(r.made, false) AS made, coalesce(r.seen, false) AS seen",
        "SELECT CAST(3 AS BIGINT) AS n, r_name AS r, false AS made, r_name = 'ASIA' AS seen FROM region UNION ALL SELECT 3, 'ATLANTIS', true, false",
    ),
    "remove_label_prop": Entry(
        "MATCH (c:Customer) WHERE c.acctbal < 0 REMOVE c.name, c:Customer WITH count(*) AS n MATCH (x) WHERE size(labels(x)) = 0 RETURN n, x.custkey AS k, x.name IS NULL AS gone",
        "SELECT (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n, c_custkey AS k, true AS gone FROM customer WHERE c_acctbal < 0",
    ),
    "foreach_write": Entry(
        "MATCH (s:Supplier) WITH collect(s) AS all FOREACH (x IN all WHERE x.acctbal < 0 | SET x.flag = x.suppkey) WITH size(all) AS total MATCH (s:Supplier) RETURN total, count(s.flag) AS flagged, sum(s.flag) AS s",
        "SELECT (SELECT count(*) FROM supplier) AS total, count(*) AS flagged, CAST(coalesce(sum(s_suppkey), 0) AS BIGINT) AS s FROM supplier WHERE s_acctbal < 0",
    ),
    "union_tail": Entry(
        "MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS b UNION ALL MATCH (s:Supplier) RETURN s.name AS name, s.acctbal AS b ORDER BY b DESC, name SKIP 3 LIMIT 8",
        "SELECT * FROM (SELECT c_name AS name, c_acctbal AS b FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) ORDER BY b DESC, name LIMIT 8 OFFSET 3",
    ),
    "call_yield": Entry(
        "MATCH (n:Nation) CALL { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN count(c) AS customers, max(c.acctbal) AS top } YIELD customers RETURN n.name AS n, customers",
        "SELECT n_name AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation",
    ),
    "call_where": Entry(
        "MATCH (n:Nation) CALL { MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN count(c) AS customers } WHERE customers > 50 RETURN n.name AS n, customers",
        "SELECT n_name AS n, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 50",
    ),
    "call_alone": Entry(
        "CALL { MATCH (s:Supplier) RETURN s.nationkey AS k, count(*) AS c }",
        "SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1",
    ),
    "exists_value": Entry(
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:DID]->(e:Event) WITH c, e WHERE EXISTS(e.value) RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer JOIN events ON user_id = c_custkey WHERE value IS NOT NULL",
    ),
    "bare_value": Entry("MATCH (c:Customer) WHERE c.nationkey RETURN count(*) AS n", "SELECT count(*) AS n FROM customer WHERE c_nationkey <> 0"),
    "map_subset": Entry("MATCH (c:Customer) WHERE c = {mktsegment: 'BUILDING', nationkey: 3} RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "types_and_ends": Entry(
        "MATCH (s:Supplier)-[r]->(n) RETURN type(r) AS t, startNode(r) AS s, endNode(r) AS e",
        "SELECT 'IN_NATION' AS t, 'Supplier:' || s_suppkey AS s, 'Nation:' || s_nationkey AS e FROM supplier",
    ),
    "keys_of_map": Entry("MATCH (r:Region) WITH r, keys({b: r.name, a: 1}) AS ks RETURN r.name AS r, size(ks) AS n, 'a' IN ks AS a, 'c' IN ks AS c", "SELECT r_name AS r, CAST(2 AS BIGINT) AS n, true AS a, false AS c FROM region"),
    "random_and_clock": Entry("MATCH (c:Customer) WITH random() AS x, timestamp() AS t WHERE x >= 0 AND x < 1 AND t > 1700000000 RETURN count(*) AS n", "SELECT count(*) AS n FROM customer"),
    "timezone_of": Entry(
        "RETURN timezone('2023-01-02T03:04:05+02:00') AS a, timezone('2023-01-02T03:04:05Z') AS b, timezone('2023-01-02T03:04:05') IS NULL AS c",
        "SELECT '+02:00' AS a, 'Z' AS b, true AS c",
    ),
    "default_names": Entry("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN c.custkey, n.name", "SELECT c_custkey AS custkey, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    "rematched_node": Entry("MATCH (c:Customer) MATCH (c:Customer) WHERE c.acctbal > 9000 RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000"),
    "nested_lambdas": Entry(
        "MATCH (n:Nation) RETURN n.name AS n, reduce(s = 0, z IN [x IN [1, 2, 3] | reduce(t = 0, y IN [x, n.nationkey] | t + x * y)] | s + z) AS v",
        "SELECT n_name AS n, CAST(14 + 6 * n_nationkey AS BIGINT) AS v FROM nation",
    ),
}


def _query(entry: Entry):
    return lambda spark, sf_dir: table_graph(spark, sf_dir, labels=entry.labels).cypher(entry.text)


def _folder(spark, name: str) -> str:
    """A new folder among those that all executors share."""
    import uuid

    from .operators.cutting import cut_lineage

    cut_lineage(spark.range(1))  # sets the session's shared folder where it has none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def load_csv(spark, sf_dir):
    """LOAD CSV of the customers, written as CSV into the shared folder first."""
    path = _folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.csv(path, header=True)
    return table_graph(spark, sf_dir).cypher(f"LOAD CSV WITH HEADERS FROM '{path}' AS row MATCH (n:Nation) WHERE n.nationkey = toInteger(row.c_nationkey) RETURN n.name AS n, count(*) AS c, sum(toInteger(row.c_custkey)) AS s")


def _places(spark, sf_dir) -> dict:
    """Nations and regions as graph JSON: data of the driver's own, and few rows at any scale."""
    nodes, edges = [], []
    for label, name, key, up, kind in (("Region", "region", "r_regionkey", None, None), ("Nation", "nation", "n_nationkey", "n_regionkey", "IN_REGION")):
        for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").toLocalIterator():
            nodes.append({"key": f"{label}:{r[key]}", "attributes": {"label": label, "name": r[f"{name[0]}_name"], "number": r[key]}})
            if up:
                edges.append({"source": f"{label}:{r[key]}", "target": f"Region:{r[up]}", "attributes": {"type": kind}})
    return {"options": {"type": "directed", "multi": True}, "nodes": nodes, "edges": edges}


_PER_REGION = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, count(n) AS nations, sum(n.number) AS numbers"
_PER_REGION_SQL = "SELECT r_name AS r, count(*) AS nations, CAST(sum(n_nationkey) AS BIGINT) AS numbers FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"


def _json_file(spark, sf_dir) -> str:
    """The path of a graph JSON file in the shared folder."""
    import json

    path = _folder(spark, "json")
    spark.createDataFrame([(json.dumps(_places(spark, sf_dir)),)], "value string").coalesce(1).write.text(path)
    names = spark.read.text(path, wholetext=True).inputFiles()
    return names[0]


def graph_from_json_file(spark, sf_dir):
    from .sources.graph_json import read_graph

    return read_graph(spark, _json_file(spark, sf_dir)).cypher(_PER_REGION)


def graph_from_json_data(spark, sf_dir):
    from . import execute_query

    return execute_query(_places(spark, sf_dir), _PER_REGION, spark)


def graph_from_builder(spark, sf_dir):
    from .sources.builder import GraphBuilder

    builder, data = GraphBuilder(), _places(spark, sf_dir)
    for n in data["nodes"]:
        builder.add_node(n["key"], **n["attributes"])
    for e in data["edges"]:
        builder.add_edge(e["source"], e["target"], **e["attributes"])
    return builder.build(spark).cypher(_PER_REGION)


def graph_from_frames(spark, sf_dir):
    """Customers and orders as generic frames, wrapped as they are."""
    from .graph import PropertyGraph

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('c', c_custkey) as id", "'Customer' as label", "c_mktsegment as segment", "cast(null as double) as price")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nodes = customers.unionByName(orders.selectExpr("concat('o', o_orderkey) as id", "'Order' as label", "cast(null as string) as segment", "o_totalprice as price"))
    edges = orders.selectExpr("concat('c', o_custkey) as source", "concat('o', o_orderkey) as target", "'PLACED' as type")
    return PropertyGraph.from_frames(nodes, edges).cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.segment AS s, count(o) AS n, max(o.price) AS top")


def graph_indexed(spark, sf_dir):
    graph = table_graph(spark, sf_dir, labels=("Customer", "Order")).indexed({"Customer": "acctbal"})
    df = graph.cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.acctbal > 0 RETURN c.mktsegment AS s, count(o) AS n, max(o.totalprice) AS top")
    rows = df.collect()  # one for each segment; what is in memory would serve other queries of the session as well
    graph.release()
    return spark.createDataFrame(rows, df.schema)


def graph_errors(spark, sf_dir):
    """What validation says of data with a repeated node, a lost end and an odd type."""
    from .errors import GraphError
    from .sources.graph_json import validate

    rows = []
    for name in ("repeated", "lost", "type"):
        data = _places(spark, sf_dir)
        if name == "repeated":
            data["nodes"].append(data["nodes"][0])
        elif name == "lost":
            data["edges"][0]["target"] = "Region:none"
        else:
            data["options"]["type"] = "odd"
        try:
            validate(data)
            rows.append((name, False))
        except GraphError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


def graph_format(spark, sf_dir):
    """A format of the user's: lines of "key>key", converted to graph JSON."""
    from .sources import formats

    def convert(content, path, label_property, edge_type_property):
        pairs = [line.split(">") for line in content.splitlines() if ">" in line]
        keys = sorted({k for p in pairs for k in p})
        return {"nodes": [{"key": k, "attributes": {label_property: k.split(":")[0]}} for k in keys], "edges": [{"source": a, "target": b, "attributes": {edge_type_property: "IN"}} for a, b in pairs]}

    if "arrows" not in formats.formats():
        formats.register_format("arrows", convert)
    path = f"{_folder(spark, 'lines')}.arrows"
    spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("concat('Supplier:', s_suppkey, '>Nation:', s_nationkey) as value").coalesce(1).write.text(path)
    return formats.load(spark, path).cypher("MATCH (s:Supplier)-[:IN]->(n:Nation) RETURN id(n) AS n, count(s) AS c")


def _cli(spark, path: str, *args) -> str:
    import io

    from . import cli

    out = io.StringIO()
    if cli.main(["-g", path, *args, "--no-cache"], spark, out):
        raise RuntimeError("the command failed")
    return out.getvalue()


def cli_rows(spark, sf_dir):
    """Rows printed by the command line, read back."""
    import json

    lines = _cli(spark, _json_file(spark, sf_dir), "-e", _PER_REGION, "--format", "rows").splitlines()
    return spark.createDataFrame([(x["r"], x["nations"], x["numbers"]) for x in map(json.loads, lines)], "r string, nations long, numbers long")


def cli_graph(spark, sf_dir):
    """Nodes and relationships printed as graph JSON, read back as a graph."""
    import json

    data = json.loads(_cli(spark, _json_file(spark, sf_dir), "-e", "MATCH (n:Nation)-[r:IN_REGION]->(g:Region) RETURN n, r, g"))
    rows = [(n["attributes"]["label"],) for n in data["nodes"]] + [("edge",)] * len(data["edges"])
    return spark.createDataFrame(rows, "kind string").groupBy("kind").count()


def cli_pass_through(spark, sf_dir):
    import json

    from .sources.graph_json import graph_from_dict

    return graph_from_dict(spark, json.loads(_cli(spark, _json_file(spark, sf_dir), "--pass-through"))).cypher(_PER_REGION)


def explained(spark, sf_dir):
    from .explain import explain

    said = explain("MATCH (c:Customer)-[:PLACED]->(o) WITH c, count(o) AS n WHERE n > 3 RETURN c.name AS name, n ORDER BY n DESC LIMIT 5")
    return spark.createDataFrame([(i, s["type"], ",".join(s["variables"])) for i, s in enumerate(said["stages"])], "i int, stage string, variables string")


def user_functions(spark, sf_dir):
    """A function of values, one of columns, and one called on a gathered list, by dotted names in any case."""
    from pyspark.sql import functions as F

    from .functions.registry import REGISTRY

    if "shop.grade" not in REGISTRY.names():
        REGISTRY.add_function("shop", "grade", lambda x: "debt" if x < 0 else "fine", "string")
        REGISTRY.add_column_function("shop", "half", lambda c: F.floor(c / 2).cast("long"), "long")
        REGISTRY.add_aggregation("shop", "spread", lambda xs: int(max(xs) - min(xs)), "long")
    return table_graph(spark, sf_dir).cypher("MATCH (c:Customer) RETURN shop.Grade(c.acctbal) AS grade, count(*) AS n, shop.half(count(*)) AS half, shop.spread(collect(c.custkey)) AS spread")


def path_guard(spark, sf_dir):
    """A bound on paths: an error, or that many paths."""
    import warnings

    from .errors import QueryError
    from .graph import GraphConfig

    text, rows = "MATCH (c:Customer)-[*1..2]->(x) RETURN count(*) AS n", []
    try:
        table_graph(spark, sf_dir, GraphConfig(max_paths=150)).cypher(text)
        rows.append(("error", 0))
    except QueryError:
        rows.append(("error", 1))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kept = table_graph(spark, sf_dir, GraphConfig(max_paths=150, on_excess="stop")).cypher(text)
    return spark.createDataFrame(rows, "what string, n long").unionByName(kept.selectExpr("'kept' as what", "n"))


SOURCES = {
    "load_csv": (load_csv, "SELECT n_name AS n, count(*) AS c, CAST(sum(c_custkey) AS BIGINT) AS s FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "graph_from_json_file": (graph_from_json_file, _PER_REGION_SQL),
    "graph_from_json_data": (graph_from_json_data, _PER_REGION_SQL),
    "graph_from_builder": (graph_from_builder, _PER_REGION_SQL),
    "graph_from_frames": (graph_from_frames, "SELECT c_mktsegment AS s, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "graph_indexed": (graph_indexed, "SELECT c_mktsegment AS s, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1"),
    "graph_errors": (graph_errors, "SELECT unnest(['repeated', 'lost', 'type']) AS name, true AS refused"),
    "graph_format": (graph_format, "SELECT 'Nation:' || s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1"),
    "cli_rows": (cli_rows, _PER_REGION_SQL),
    "cli_graph": (cli_graph, "SELECT 'Nation' AS kind, count(*) AS count FROM nation UNION ALL SELECT 'Region', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'edge', count(*) FROM nation"),
    "cli_pass_through": (cli_pass_through, _PER_REGION_SQL),
    "explained": (explained, "SELECT unnest([0, 1, 2])::INT AS i, unnest(['MATCH', 'WITH', 'RETURN']) AS stage, unnest(['c,o', 'c,n', 'name,n']) AS variables"),
    "user_functions": (user_functions, "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS grade, count(*) AS n, count(*) // 2 AS half, CAST(max(c_custkey) - min(c_custkey) AS BIGINT) AS spread FROM customer GROUP BY 1"),
    "path_guard": (path_guard, "SELECT 'error' AS what, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'kept', 150"),
}

QUERIES = {name: _query(e) for name, e in ENTRIES.items()} | {name: f for name, (f, _) in SOURCES.items()}
ORACLE_SQL = {name: e.sql for name, e in ENTRIES.items() if e.sql} | {name: sql for name, (_, sql) in SOURCES.items()}
