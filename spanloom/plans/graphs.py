"""Graph queries over the foreign keys of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators.search import top
from spanloom.plans.base import EDGES, NODES, edges, nodes
from spanloom.plans.catalog import register
from spanloom.runtime import table

INDEX = "ix AS (SELECT DISTINCT k AS key, u.path FROM edges e JOIN nodes d ON d.id = e.dst JOIN nodes u ON u.id = e.src, LATERAL (SELECT unnest(list_distinct([d.id, string_split(d.id, ':')[2], d.name])) AS k) WHERE e.type IN ('IMPORTS', 'EXTENDS'))"


@register("symbol_index", "G1 G16", f"WITH {NODES}, {EDGES}, {INDEX} SELECT key, path FROM ix")
def symbol_index(spark, sf):
    return G.user_files(nodes(spark, sf), edges(spark, sf), ["IMPORTS", "EXTENDS"])


@register("where_used", "G2 J16", f"WITH {NODES}, {EDGES}, {INDEX}, q(symbol) AS (SELECT n_name FROM nation UNION ALL SELECT r_name FROM region) SELECT symbol, path, CAST(n AS INTEGER) AS \"rank\" FROM (SELECT symbol, path, row_number() OVER (PARTITION BY symbol ORDER BY path) AS n FROM q JOIN ix ON ix.key = symbol) WHERE n <= 10")
def where_used(spark, sf):
    n = nodes(spark, sf)
    q = n.filter("kind IN ('class', 'module')").select(F.col("name").alias("symbol"))
    return G.where_used(G.user_files(n, edges(spark, sf), ["IMPORTS", "EXTENDS"]), q, 10)


@register("lineage_files", "G3 G21", f"WITH {NODES}, {EDGES} SELECT DISTINCT s.id AS symbol, d.path FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst WHERE e.type IN ('IMPORTS', 'USES')")
def lineage_files(spark, sf):
    i = G.user_files(nodes(spark, sf), edges(spark, sf), ["IMPORTS", "USES"], callee=True)
    return nodes(spark, sf).select(F.col("id").alias("symbol")).join(i, F.col("symbol") == F.col("key")).select("symbol", "path").distinct()


@register("lineage_depth5", "G6", f"WITH RECURSIVE {EDGES}, w(start, id, d) AS (SELECT src, dst, 1 FROM edges UNION SELECT w.start, edges.dst, w.d + 1 FROM w JOIN edges ON edges.src = w.id WHERE w.d < 5) SELECT start, id, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY start, id")
def lineage_depth5(spark, sf):
    return G.reach(edges(spark, sf), None, 5)


@register("khop_both", "G5 R18 J18", f"WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT 'r:' || r_regionkey AS id FROM region), w(start, id, d) AS (SELECT s.id, b.dst, 1 FROM s JOIN b ON b.src = s.id UNION SELECT w.start, b.dst, w.d + 1 FROM w JOIN b ON b.src = w.id WHERE w.d < 3) SELECT start, id, CAST(min(d) AS INTEGER) AS distance FROM w GROUP BY start, id")
def khop_both(spark, sf):
    return G.reach(edges(spark, sf), nodes(spark, sf).filter("kind = 'module'").select("id"), 3, both=True)


@register("two_hop_neighbors", "J16 J17", f"WITH {NODES}, {EDGES}, x AS (SELECT DISTINCT e.src, m.id AS mid, f.dst FROM edges e JOIN nodes m ON m.id = e.dst JOIN edges f ON f.src = m.id WHERE e.type = 'IMPORTS') SELECT src, count(*) AS n, min(dst) AS first FROM x GROUP BY src")
def two_hop_neighbors(spark, sf):
    e = edges(spark, sf)
    a = e.filter("type = 'IMPORTS'").join(nodes(spark, sf).select(F.col("id").alias("dst")), "dst").select("src", F.col("dst").alias("mid"))
    x = a.join(e.select(F.col("src").alias("mid"), F.col("dst").alias("end")), "mid").select("src", "mid", "end").distinct()
    return x.groupBy("src").agg(F.count("*").alias("n"), F.min("end").alias("first"))


@register("file_neighbours", "J18 G16 R18", f"WITH {NODES}, {EDGES}, p AS (SELECT DISTINCT a.path AS a, b.path AS b FROM edges JOIN nodes a ON a.id = edges.src JOIN nodes b ON b.id = edges.dst WHERE a.path <> b.path) SELECT a AS file, b AS neighbour FROM p UNION SELECT b, a FROM p")
def file_neighbours(spark, sf):
    n = nodes(spark, sf).select("id", "path")
    p = edges(spark, sf).join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().toDF("file", "neighbour")


@register("indegree", "G8 G11", f"WITH {NODES}, {EDGES}, c AS (SELECT count(*) AS n FROM nodes), d AS (SELECT dst, count(*) AS k FROM edges GROUP BY dst) SELECT nodes.id, round(coalesce(k, 0) * 1.0 / (n - 1), 6) AS centrality FROM nodes LEFT JOIN d ON d.dst = nodes.id, c WHERE NOT starts_with(nodes.path, 'customer')")
def indegree(spark, sf):
    n = nodes(spark, sf)
    d = edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    c = n.agg((F.count("*") - 1).alias("m"))
    return n.filter(~F.col("path").startswith("customer")).join(d, "id", "left").crossJoin(c).select("id", F.round(F.coalesce("k", F.lit(0)) / F.col("m"), 6).alias("centrality"))  # one row


@register("pagerank", "G7 G11 G12", None)
def pagerank(spark, sf):
    return G.pagerank(edges(spark, sf), nodes(spark, sf)).select("id", F.round("score", 8).alias("score"))


@register("shortest_path", "G9", f"WITH RECURSIVE {EDGES}, w(src, dst, d) AS (SELECT src, dst, 1 FROM edges WHERE starts_with(src, 'c:') UNION SELECT w.src, e.dst, w.d + 1 FROM w JOIN edges e ON e.src = w.dst WHERE w.d < 4) SELECT src, dst, CAST(min(d) AS INTEGER) AS hops FROM w WHERE starts_with(src, 'c:') AND starts_with(dst, 'r:') GROUP BY src, dst")
def shortest_path(spark, sf):
    e = edges(spark, sf)
    c = e.filter("type = 'USES'").select("src").distinct()
    r = e.filter("type = 'EXTENDS'").select("dst").distinct()
    return G.shortest_paths(e, c.crossJoin(F.broadcast(r)), 4).select("src", "dst", "hops")  # five regions


def part_of(spark, sf):
    """The graph, and a way back from every tenth supplier to the part that has its number."""
    t = table(spark, sf, "supplier").filter("s_suppkey % 10 = 0").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    back = t.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("long")).alias("src"), F.concat(F.lit("p:"), F.col("p_partkey").cast("long")).alias("dst"))
    return edges(spark, sf).select("src", "dst").unionByName(back)


@register("cycles_bounded", "G10", f"""WITH RECURSIVE {EDGES}, k AS (SELECT s_suppkey AS k FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 10 = 0),
g AS (SELECT src, dst FROM edges UNION SELECT 's:' || k, 'p:' || k FROM k), v AS (SELECT 's:' || k AS id FROM k UNION ALL SELECT 'p:' || k FROM k),
e AS (SELECT src, dst FROM g WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)),
w(path, closed) AS (SELECT [src], false FROM e GROUP BY src UNION ALL SELECT CASE WHEN e.dst = w.path[1] THEN w.path ELSE w.path || [e.dst] END, e.dst = w.path[1]
  FROM w JOIN e ON e.src = w.path[-1] WHERE NOT w.closed AND len(w.path) <= 8 AND (e.dst = w.path[1] OR e.dst > w.path[1] AND NOT list_contains(w.path, e.dst) AND len(w.path) < 8))
SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS nodes FROM w WHERE closed ORDER BY len(path), path LIMIT 10""")
def cycles_bounded(spark, sf):
    """The ten shortest cycles of up to eight nodes."""
    return G.cycles(part_of(spark, sf), 8, 10).select(F.array_join("path", ">").alias("cycle"), F.size("path").alias("nodes"))


@register("path_nodes", "G9", f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
pr AS (SELECT 'c:' || c_custkey AS a, 'p:' || p_partkey AS b FROM customer JOIN part ON p_partkey = c_custkey % 97 + 1 WHERE c_custkey % 50 = 0),
f(a, id, d) AS (SELECT DISTINCT a, a, 0 FROM pr UNION SELECT f.a, u.dst, f.d + 1 FROM f JOIN u ON u.src = f.id WHERE f.d < 6),
h AS (SELECT a, id, min(d) AS d FROM f GROUP BY ALL),
r(a, b, id, d) AS (SELECT pr.a, pr.b, pr.b, h.d FROM pr JOIN h ON h.a = pr.a AND h.id = pr.b UNION SELECT r.a, r.b, h.id, h.d FROM r JOIN u ON u.dst = r.id JOIN h ON h.a = r.a AND h.id = u.src AND h.d = r.d - 1),
w(a, b, path, d) AS (SELECT DISTINCT a, b, [a], 0 FROM r UNION ALL SELECT w.a, w.b, w.path || [min(r.id)], w.d + 1 FROM w JOIN r ON r.a = w.a AND r.b = w.b AND r.d = w.d + 1 JOIN u ON u.src = w.path[-1] AND u.dst = r.id GROUP BY w.a, w.b, w.path, w.d)
SELECT a AS src, b AS dst, CAST(max(d) AS INTEGER) AS hops, array_to_string(max_by(path, d), '>') AS path FROM w GROUP BY ALL""")
def path_nodes(spark, sf):
    """The chain of nodes between a part and every fiftieth customer, edges taken both ways."""
    c, p = table(spark, sf, "customer").filter("c_custkey % 50 = 0"), table(spark, sf, "part")
    pairs = c.join(p, F.col("p_partkey") == F.col("c_custkey") % 97 + 1).select(F.concat(F.lit("c:"), F.col("c_custkey").cast("long")).alias("src"), F.concat(F.lit("p:"), F.col("p_partkey").cast("long")).alias("dst"))
    return G.shortest_paths(edges(spark, sf), pairs, 6, both=True).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))


@register("file_context", "G13 G14 J21", f"""WITH {NODES}, {EDGES}, d AS (SELECT src AS id, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS n FROM (SELECT DISTINCT src, dst FROM edges)),
o AS (SELECT id, count(*) AS n_callees, string_agg(CASE WHEN n <= 5 THEN dst END, ',' ORDER BY dst) AS callees FROM d GROUP BY id),
x AS (SELECT src AS id, max(CASE WHEN type = 'EXTENDS' THEN dst END) AS extends FROM edges GROUP BY src), i AS (SELECT dst AS id, count(DISTINCT src) AS callers, min(src) AS first_caller FROM edges GROUP BY dst)
SELECT n.id, coalesce(o.n_callees, 0) AS n_callees, o.callees, x.extends, coalesce(i.callers, 0) AS callers, i.first_caller FROM nodes n LEFT JOIN o USING (id) LEFT JOIN x USING (id) LEFT JOIN i USING (id)""")
def file_context(spark, sf):
    """Of every node: how many it calls and the first five, what it extends, and who calls it."""
    e = edges(spark, sf)
    d = e.select(F.col("src").alias("id"), "dst").distinct()
    few = top(d, ["id"], 5, F.col("dst")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("callees"))
    x = e.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("type") == "EXTENDS", F.col("dst"))).alias("extends"), F.count_distinct("dst").alias("n_callees"))
    i = e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"), F.min("src").alias("first_caller"))
    r = nodes(spark, sf).select("id").join(x, "id", "left").join(few, "id", "left").join(i, "id", "left")
    return r.select("id", F.coalesce("n_callees", F.lit(0)).alias("n_callees"), "callees", "extends", F.coalesce("callers", F.lit(0)).alias("callers"), "first_caller")


@register("inspect_entity", "G15 O11", f"WITH {NODES}, {EDGES}, p AS (SELECT dst AS id, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS n FROM edges WHERE type IN ('USES', 'IMPORTS')) SELECT nodes.id, nodes.kind, string_agg(p.src, ',' ORDER BY n) AS users FROM nodes LEFT JOIN p ON p.id = nodes.id AND n <= 3 WHERE kind IN ('class', 'module') GROUP BY ALL")
def inspect_entity(spark, sf):
    p = top(edges(spark, sf).filter("type IN ('USES', 'IMPORTS')").select(F.col("dst").alias("id"), "src"), ["id"], 3, F.col("src"))
    u = p.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("users"))
    return nodes(spark, sf).filter("kind IN ('class', 'module')").select("id", "kind").join(u, "id", "left")


@register("entity_search", "G20 C14", f"WITH {NODES} SELECT id, name, kind FROM nodes WHERE contains(lower(name), 'an') AND kind IN ('class', 'module', 'variable') AND (lower(name) LIKE '%an%' OR lower(path) LIKE '%an%')")
def entity_search(spark, sf):
    n = nodes(spark, sf)
    return n.filter(F.lower("name").contains("an") & F.col("kind").isin("class", "module", "variable") & (F.col("name").ilike("%an%") | F.col("path").ilike("%an%"))).select("id", "name", "kind")


CODE_SQL = """code AS (SELECT 'doc' || doc_id || '.py' AS path, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 1
  THEN '  def ' || split_part(x, ' ', 1) || '(self):' ELSE regexp_replace(x, '^([^ ]+) ([^ ]+)', '\\1 \\2(') END), chr(10)) AS text FROM documents)"""


@register("text_scan_graph", "U19", f"""WITH {CODE_SQL}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS line FROM code),
n AS (SELECT DISTINCT trim(regexp_extract(ltrim(line), '^(?:def|class) ([^(:]*)', 1)) AS name FROM l WHERE starts_with(ltrim(line), 'def ') OR starts_with(ltrim(line), 'class ')),
c AS (SELECT path, name FROM code JOIN n ON contains(text, name || '(') WHERE name <> '')
SELECT 'CALLS' AS type, path AS src, name AS dst FROM c UNION ALL SELECT 'CALLS', name, path FROM c""")
def text_scan_graph(spark, sf):
    """Files made of the documents' lines: every fourth line defines its first word, the others call their second."""
    line = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("  def "), F.split(x, " ", 2)[0], F.lit("(self):"))).otherwise(F.regexp_replace(x, "^([^ ]+) ([^ ]+)", "$1 $2("))
    code = table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".py")).alias("path"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))
    return G.text_scan(code)[1]
