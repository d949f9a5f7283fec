"""Searches and checks that are composed of other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import search
from spanloom.runtime import write_once


def stitch(results: DataFrame, neighbours: DataFrame, limit: int) -> DataFrame:
    """(query_id, path, rank, origin): results (query_id, path, rank), then neighbours (file, neighbour) of result files, the nearest result's first, to fill the limit."""
    n = results.join(neighbours.toDF("path", "to"), "path").groupBy("query_id", "to").agg(F.min("rank").alias("near"))
    n = n.join(results.select("query_id", F.col("path").alias("to")), ["query_id", "to"], "left_anti").select("query_id", F.col("to").alias("path"), F.lit(1).alias("stage"), F.col("near").alias("at"), F.lit("neighbour").alias("origin"))
    both = results.select("query_id", "path", F.lit(0).alias("stage"), F.col("rank").alias("at"), F.lit("hit").alias("origin")).unionByName(n)
    return search.top(both, ["query_id"], limit, F.col("stage"), F.col("at"), F.col("path")).select("query_id", "path", "rank", "origin")


def _level(n: Column | str) -> Column:
    return F.floor(F.log2(n)).cast("int")


def _numbered(neighbours: DataFrame) -> DataFrame:
    """(path, to, n, level): distinct neighbours (path, to), numbered by name, and the power of two of the number."""
    near = neighbours.toDF("path", "to").distinct().withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("to")))
    return near.withColumn("level", _level("n"))


def _first(front: DataFrame, near: DataFrame) -> DataFrame:
    """Rows of a front (path, most, …) with each of the ``most`` first neighbours of their node; no more than twice as many rows are joined."""
    f = front.withColumn("level", F.explode(F.sequence(F.lit(0), _level("most"))))
    return f.join(near, ["path", "level"]).filter(F.col("n") <= F.col("most"))


def stitch_hops(seeds: DataFrame, neighbours: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, path, hop, rank) of neighbours of the seeds (query_id, path, quota), nearest first, until a query's quota is filled; of a hop, by path.

    All queries are searched at once, a hop a round. A query whose quota is filled leaves the search. Of a node's neighbours, in order, a query can only take as many as are
    left of its quota beyond those that it has seen: neighbours are numbered and found by number, in steps of powers of two, so that a hub is never joined whole.
    """
    near = write_once(_numbered(neighbours), "near")
    before = write_once(seeds.select("query_id", "path").distinct(), "stitched")
    state = write_once(seeds.groupBy("query_id").agg(F.max("quota").alias("left"), F.count_distinct("path").alias("seen")).withColumn("used", F.lit(0).cast("long")), "quota")
    front, out, parts = before, None, [before]
    for hop in range(1, max(1, hops) + 1):
        f = front.join(state.filter("left > 0"), "query_id").withColumn("most", F.col("left") + F.col("seen"))
        new = _first(f, near).select("query_id", F.col("to").alias("path"), "left", "used")
        for s in parts:
            new = new.unionByName(s.select("query_id", "path"), allowMissingColumns=True)
        # one shuffle, by query, is enough for the rest of the round; what a query has seen has no quota
        new = new.repartition("query_id").groupBy("query_id", "path").agg(F.max("left").alias("left"), F.max("used").alias("used"), F.bool_or(F.col("left").isNull()).alias("old")).filter("NOT old")
        place = F.row_number().over(W.partitionBy("query_id").orderBy("path"))
        new = new.withColumn("place", place).filter(F.col("place") <= F.col("left"))
        new = write_once(new.select("query_id", "path", F.lit(hop).alias("hop"), (F.col("used") + F.col("place")).cast("int").alias("rank")), "stitched")
        out = new if out is None else out.unionByName(new)
        got = new.groupBy("query_id").agg(F.count("*").alias("got"))
        got = state.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.lit(0)))
        state = write_once(got.select("query_id", (F.col("left") - F.col("got")).alias("left"), (F.col("seen") + F.col("got")).alias("seen"), (F.col("used") + F.col("got")).alias("used")), "quota")
        front = new.join(state.filter("left > 0").select("query_id"), "query_id", "left_semi").select("query_id", "path")
        parts.append(front)
        if hop == hops or not front.limit(1).count():
            break
    return out


def nav_search(docs: DataFrame, queries: DataFrame, neighbours: DataFrame, fresh: bool = True, limit: int = 10) -> DataFrame:
    """(query_id, path, rank, origin) of documents (id, path, text) for queries (query_id, text).

    With a fresh index: full-text hits (three limits, a hundred at least), reranked, the best stitched with graph neighbours. Queries without a hit, or
    all if the index is stale, are looked up literally: documents that contain the query, by path.
    """
    index, figures = search.index_for(docs, queries)
    h = search.bm25(index, queries, figures["n_docs"], figures["avg_len"])
    h = h.filter(F.lit(fresh))
    h = write_once(search.top(h, ["query_id"], max(100, 3 * limit), F.desc(F.round("score_pos", 5)), F.col("id")).drop("rank"), "hits")
    r = search.rerank_hits(h, docs, queries).select("query_id", "path", F.round("rerank", 6).alias("score"))
    best = search.top(r, ["query_id"], limit, F.desc("score"), F.col("path")).select("query_id", "path", "rank")
    out = stitch(best, neighbours, limit)
    lost = queries.join(best.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lower("text").alias("needle")).filter("needle <> ''")
    low = docs.select("path", F.lower("text").alias("low"))
    found = search.rows_with(low, lost, "path", "low", "needle").join(lost, "needle").select("query_id", "path")
    grep = search.top(found, ["query_id"], limit, F.col("path")).select("query_id", "path", "rank", F.lit("grep").alias("origin"))
    return out.unionByName(grep)


def hybrid(vector_hits: DataFrame, entities: DataFrame, neighbours: DataFrame, most: int = 15) -> DataFrame:
    """(query_id, id, origin, rank, density): vector hits (query_id, id, rank), then what the graph adds to them: of each entity (query_id, entity) that a relational
    query names, the nearest ``most`` neighbours (entity, id, distance). Density is the number of graph results over the number of merged ones."""
    near = neighbours.join(entities.select("entity").distinct(), "entity", "left_semi")  # an entity's nearest are picked once, before any query meets them
    near = search.top(near, ["entity"], most, F.col("distance"), F.col("id")).select("entity", "id", "distance")
    g = write_once(entities.join(near, "entity").select("query_id", "id", "distance"), "near")
    v = vector_hits.select("query_id", "id", F.struct(F.lit(0).alias("stage"), F.col("rank").alias("at")).alias("x"))
    first = v.unionByName(g.select("query_id", "id", F.struct(F.lit(1).alias("stage"), F.col("distance").alias("at")).alias("x"))).groupBy("query_id", "id").agg(F.min("x").alias("x"))
    n = first.groupBy("query_id").agg(F.count("*").alias("n")).join(g.groupBy("query_id").agg(F.count("*").alias("g")), "query_id", "left")
    r = search.top(first, ["query_id"], 1 << 30, F.col("x"), F.col("id")).select("query_id", "id", F.when(F.col("x.stage") == 0, "vector").otherwise("graph").alias("origin"), "rank")
    return r.join(n.select("query_id", (F.coalesce("g", F.lit(0)) / F.col("n")).alias("density")), "query_id")


def explained(hits: DataFrame, entities: DataFrame, edges: DataFrame, summaries: DataFrame, most: int = 5) -> DataFrame:
    """Hits (query_id, file, start, end) with debug columns: the entity that overlaps a hit's lines most closely, its first parents and children, and its summary."""
    e = entities.select("file", F.col("id").alias("entity"), F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    over = hits.join(e, "file").filter((F.col("e_end") >= F.col("start")) & (F.col("e_start") <= F.col("end")))
    keys = [c for c in hits.columns]
    one = over.groupBy(*keys).agg(F.min(F.struct((F.col("e_end") - F.col("e_start")).alias("size"), "entity")).alias("x")).select(*keys, F.col("x.entity").alias("entity"))
    r = hits.join(one, keys, "left")

    def named(of: str, other: str, name: str) -> DataFrame:
        t = search.top(edges.select(F.col(of).alias("entity"), F.col(other).alias("o")).distinct(), ["entity"], most, F.col("o"))
        return t.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias(name))

    return r.join(named("dst", "src", "parents"), "entity", "left").join(named("src", "dst", "children"), "entity", "left").join(summaries.select("entity", "summary"), "entity", "left")


def trimmed(hits: DataFrame, budget: int, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, pick, used), (query_id, given, relevant, kept, used)): hits (query_id, id, relevance, text) of enough relevance, made diverse, up to a token budget."""
    good = hits.filter(F.col("relevance") >= least)
    m = search.mmr(good).join(good.select("query_id", "id", F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tok")), ["query_id", "id"])
    run = F.sum("tok").over(W.partitionBy("query_id").orderBy("pick").rowsBetween(W.unboundedPreceding, 0))
    kept = m.withColumn("used", run).filter(F.col("used") <= budget)
    stats = hits.groupBy("query_id").agg(F.count("*").alias("given"), F.count_if(F.col("relevance") >= least).alias("relevant"))
    stats = stats.join(kept.groupBy("query_id").agg(F.count("*").alias("kept"), F.max("used").alias("used")), "query_id", "left")
    return kept.select("query_id", "id", "pick", "used"), stats.select("query_id", "given", "relevant", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("used", F.lit(0)).alias("used"))


def doctor(counts: DataFrame) -> DataFrame:
    """(status, issues) of one row (spans, orphans, pending_enrichments, pending_embeddings)."""
    status = F.when((F.col("orphans") > 0), "WARN").when(F.col("spans") == 0, "EMPTY").when((F.col("pending_enrichments") > 0) | (F.col("pending_embeddings") > 0), "WARN").otherwise("OK")
    said = [
        F.when(F.col("spans") == 0, "no spans"), F.when(F.col("orphans") > 0, F.concat("orphans", F.lit(" enrichments without span"))),
        F.when(F.col("pending_enrichments") > 0, F.concat("pending_enrichments", F.lit(" spans without enrichment"))),
        F.when(F.col("pending_embeddings") > 0, F.concat("pending_embeddings", F.lit(" spans without embedding"))),
    ]
    return counts.select("*", status.alias("status"), F.array_compact(F.array(*said)).alias("issues"))


def clinical_lookup(edges: DataFrame, nodes: DataFrame, names: DataFrame, kind: str, prefix: str, least: float = 0.0) -> DataFrame:
    """(name, target, type, confidence, rank) of the edges (source_id, target_id, edge_type, confidence) of a kind from the named conditions or drugs, the surest first."""
    q = names.select("name", F.concat(F.lit(f"{prefix}:"), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))).alias("source_id"))
    e = edges.filter((F.col("edge_type") == kind) & (F.col("confidence") >= least)).join(q, "source_id")
    e = e.join(nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("target"), F.col("node_type").alias("type")), "target_id")
    return search.top(e, ["name"], 1 << 30, F.desc("confidence"), F.col("target")).select("name", "target", "type", "confidence", "rank")


def clinical_graph(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, name, node_type) and edges (source_id, target_id, edge_type, confidence) of relations (source, target, type, confidence)."""
    ident = lambda kind, name: F.concat(F.lit(f"{kind}:"), F.replace(F.lower(name), F.lit(" "), F.lit("_")))
    adverse, test = F.col("type") == "ADVERSE_EVENT", F.col("type") == "MONITORED_BY"
    r = relations.select(ident("condition", F.col("source")).alias("source_id"), ident("drug", F.col("target")).alias("target_id"), "source", "target", "type", "confidence")
    a = r.select(F.col("source_id").alias("node_id"), F.col("source").alias("name"), F.when(adverse, "drug").otherwise("condition").alias("node_type"))
    b = r.select(F.col("target_id").alias("node_id"), F.col("target").alias("name"), F.when(test, "test").when(adverse, "symptom").otherwise("drug").alias("node_type"))
    nodes = a.unionByName(b).groupBy("node_id").agg(F.min(F.struct("node_type", "name")).alias("x")).select("node_id", "x.name", "x.node_type")
    return nodes, r.select("source_id", "target_id", F.col("type").alias("edge_type"), "confidence").distinct()


def edges_like(edges: DataFrame, least: float | None = None, types: list[str] | None = None, origin: str | None = None) -> DataFrame:
    """Edges (…, score, edge_type, origin) of enough confidence, of given types, of one origin."""
    e = edges.filter(F.col("score") >= least) if least is not None else edges
    e = e.filter(F.col("edge_type").isin(*types)) if types is not None else e
    return e.filter(F.col("origin") == origin) if origin is not None else e


def choose_chain(override: Column, slice_type: Column, routes: dict[str, str], chains: dict[str, list[tuple[str, str]]], default: str, max_tier: str | None = None, tiers: tuple[str, ...] = ("local", "mid", "premium")) -> Column:
    """Struct (chain, backends, tier): an override, else the route of the slice's type, else the default; a chain that does not exist or is empty gives way to the
    default. ``max_tier`` keeps the backends (name, tier) up to it, unless none is left."""
    wanted = F.coalesce(override, F.element_at(F.create_map(*[F.lit(x) for kv in routes.items() for x in kv]), slice_type), F.lit(default))
    chain = F.when(wanted.isin(*[c for c, b in chains.items() if b]), wanted).otherwise(default)
    backends, tier = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, specs in chains.items():
        few = [b for b, t in specs if max_tier and t in tiers and tiers.index(t) <= tiers.index(max_tier)]
        backends = F.when(chain == name, ",".join(few or [b for b, _ in specs])).otherwise(backends)
        tier = F.when(chain == name, F.lit(max_tier if few else None)).otherwise(tier)
    return F.struct(chain.alias("chain"), backends.alias("backends"), tier.alias("tier"))
