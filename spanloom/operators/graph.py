"""Graph operators over nodes (id, name, kind, path) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.symbols import candidate_keys
from spanloom.runtime import discard, write_once


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and a stub for each id that only edges name."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    stubs = ids.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("stub").alias("kind"), F.lit("<external>").alias("path"))
    return nodes.unionByName(stubs, allowMissingColumns=True)


def both_ways(edges: DataFrame, reverse: dict[str, str]) -> DataFrame:
    """Edges (src, dst, edge) and their reversals under the reverse name."""
    back = F.element_at(F.create_map(*[F.lit(x) for kv in reverse.items() for x in kv]), F.col("edge"))
    return edges.union(edges.select(F.col("dst"), F.col("src"), back)).distinct()


def user_files(nodes: DataFrame, edges: DataFrame, types: list[str], callee: bool = False) -> DataFrame:
    """(key, path): files of the nodes that use a symbol (or, with ``callee``, that a symbol uses), by each of its candidate keys."""
    a, b = ("src", "dst") if callee else ("dst", "src")
    e = edges.filter(F.col("type").isin(*types)).select(F.col(a).alias("of"), F.col(b).alias("other"))
    names = nodes.select(F.col("id").alias("of"), F.explode(F.array_union(candidate_keys(F.col("id")), candidate_keys(F.col("name")))).alias("key"))
    paths = nodes.filter("path IS NOT NULL AND path <> ''").select(F.col("id").alias("other"), "path")
    return e.join(names, "of").join(paths, "other").select("key", "path").distinct()


def where_used(index: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """(symbol, rank, path): exact keys first, then keys that end in ``.symbol``; at most ``limit`` files, by path."""
    exact = symbols.join(index, F.col("symbol") == F.col("key")).select("symbol", "path", F.lit(0).alias("stage"))
    parts = index.select("path", F.explode(F.split("key", r"\.")).alias("leaf"), "key").filter(F.col("key").contains("."))
    suffix = symbols.join(parts, F.col("symbol") == F.col("leaf")).filter(F.col("key").endswith(F.concat(F.lit("."), F.col("symbol")))).select("symbol", "path", F.lit(1).alias("stage"))
    best = exact.unionByName(suffix).groupBy("symbol", "path").agg(F.min("stage").alias("stage"))
    n = F.row_number().over(W.partitionBy("symbol").orderBy("stage", "path"))
    return best.withColumn("rank", n).filter(F.col("rank") <= limit).select("symbol", "rank", "path")


def reach(edges: DataFrame, starts: DataFrame | None, hops: int, both: bool = False) -> DataFrame:
    """(start, id, distance) of the nodes within ``hops`` of each start (id; None: every node that an edge leaves); the start itself only through a cycle.

    Edges are written once. 64 starts share a row: a layer has a row per block of starts and node, with the mask of the starts at that distance, so that what rounds join and
    shuffle grows with the edges and not with the pairs. From the second round on only edges that leave some edge's end are joined, and of earlier layers only nodes that are
    reached again. Pairs are made at the end, from a block's names; the search ends when a layer is empty.
    """
    e = edges.select("src", "dst")
    e = write_once(e.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))) if both else e, "edges")
    ids = write_once((e.select("src") if starts is None else starts.select("id")).distinct(), "starts")
    number = write_once(_numbered(ids, "start"), "numbered")
    front = number.select("blk", F.col("start").alias("id"), F.expr("shiftleft(1L, bit)").alias("mask"))
    step, layers = e, []
    for d in range(hops):
        if d == 1 and not both:
            step = write_once(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "edges")
        new = front.join(step, F.col("id") == F.col("src")).select("blk", F.col("dst").alias("id"), "mask").groupBy("blk", "id").agg(F.bit_or("mask").alias("mask"))
        if layers:
            new = write_once(new, "reached")
            again = write_once(new.select("id").distinct(), "again")
            new = new.withColumn("old", F.lit(0).cast("long"))
            for s in layers:
                new = new.unionByName(s.join(again, "id", "left_semi").select("blk", "id", F.lit(0).cast("long").alias("mask"), F.col("mask").alias("old")))
            new = new.groupBy("blk", "id").agg(F.bit_or("mask").alias("mask"), F.bit_or("old").alias("old")).select("blk", "id", F.expr("mask & ~old").alias("mask")).filter("mask <> 0")
        front = write_once(new, "layer")
        layers.append(front)
        if not front.limit(1).count():
            break
    discard(e)
    names = number.groupBy("blk").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "start"))), lambda x: x["start"]).alias("names"))  # 64 at most
    rows = _union([x.withColumn("distance", F.lit(d)) for d, x in enumerate(layers, 1)]).join(names, "blk")
    one = F.array(F.get("names", F.round(F.log2(F.abs(F.col("mask").cast("double")))).cast("int")))
    mine = F.when(F.bit_count("mask") == 1, one).otherwise(F.filter("names", lambda x, i: F.getbit(F.col("mask"), i) == 1))
    return rows.select(F.explode(mine).alias("start"), "id", "distance")


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(id, score) with dangling mass spread evenly; scores sum to 1; stops when the L1 change is below n * tolerance."""
    e = edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = write_once(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")), "pre")
    ids = nodes.select("id").union(e.select("src")).union(e.select("dst")).distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    r = write_once(ids.join(out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("total").isNull().alias("dangling"), F.lit(1.0 / n).alias("score")), "prs")
    lost = r.filter("dangling").count() / n
    for _ in range(most):
        got = e.join(r.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        new = r.join(got, "id", "left").select("id", "dangling", F.col("score").alias("old"), (F.lit((1 - alpha) / n + alpha * lost / n) + alpha * F.coalesce("got", F.lit(0.0))).alias("score"))
        new = write_once(new, "prs")
        moved, lost = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0))).first()
        discard(r)
        r = new.select("id", "dangling", "score")
        r._spanloom_path = new._spanloom_path
        if moved < n * tolerance:
            break
    return r.select("id", "score")


def _numbered(ids: DataFrame, name: str) -> DataFrame:
    """(name, blk, bit): a bit of a 64-bit mask for every distinct value of a column; values are numbered within buckets of about a thousand."""
    d = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    buckets = max(1, -(-d.count() // 1024))
    n = F.row_number().over(W.partitionBy("_b").orderBy(name)) - 1
    d = d.withColumn("_b", F.pmod(F.xxhash64(name), F.lit(buckets))).withColumn("_n", n)
    return d.select(name, (F.col("_b") + F.floor(F.col("_n") / 64) * buckets).cast("long").alias("blk"), (F.col("_n") % 64).cast("int").alias("bit"))


def _bits(mask: str):
    """A row per bit of a mask that is set."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col(mask), i) == 1))


def _mask(bit: str):
    """The mask of the bits of a group."""
    return F.bit_or(F.expr(f"shiftleft(1L, {bit})"))


def _layer(front: DataFrame, step: DataFrame, seen: list[DataFrame], who: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(blk, id, mask) of the nodes one step (at, to) from a front that none of the layers ``seen`` holds, for the origins (blk, open) only, among the nodes ``within`` (id)."""
    f = front.join(who, "blk").select("blk", "id", F.col("mask").bitwiseAND(F.col("open")).alias("mask")).filter("mask <> 0")
    new = f.join(step, F.col("id") == F.col("at")).select("blk", F.col("to").alias("id"), "mask")
    if within is not None:
        new = new.join(within, "id", "left_semi")
    new = new.groupBy("blk", "id").agg(F.bit_or("mask").alias("mask")).withColumn("old", F.lit(0).cast("long"))
    for s in seen:
        new = new.unionByName(s.select("blk", "id", F.lit(0).cast("long").alias("mask"), F.col("mask").alias("old")))
    new = new.groupBy("blk", "id").agg(F.bit_or("mask").alias("mask"), F.bit_or("old").alias("old"))
    return write_once(new.select("blk", "id", F.expr("mask & ~old").alias("mask")).filter("mask <> 0"), "layer")


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 8, both: bool = False) -> DataFrame:
    """(src, dst, hops, path) of given pairs (src, dst): the least, in the order of its nodes, of the shortest paths of at most ``most`` edges.

    A source with one way out is searched from its only neighbour, a target with one way in from its own, so that all that hang on a hub share its search. Searches are kept by
    source and by target, not by pair, and 64 of them share a row: a layer has a row per node, with the mask of the origins at that distance, and no paths. In a round the smaller front
    takes a step, and origins without an open pair take part no more. Where a pair's fronts met, distances to its target are carried back over the nodes that its sources reached; then
    each pair walks from its source to the least neighbour that is nearer.
    """
    e = edges.select("src", "dst").filter("src <> dst")  # no shortest path has a loop
    e = write_once(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both else e, "edges")
    p = write_once(pairs.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "pairs")

    def only(end: str, other: str, name: str) -> DataFrame:
        g = e.join(p.select(end).distinct(), end, "left_semi").groupBy(end).agg(F.min(other).alias(name), F.max(other).alias("_max"))
        return g.filter(F.col(name) == F.col("_max")).select(end, name)

    lead, tail = (F.col("src") != F.col("dst")) & F.col("_to").isNotNull(), (F.col("a") != F.col("dst")) & F.col("_from").isNotNull()
    p = p.join(only("src", "dst", "_to"), "src", "left").withColumn("a", F.when(lead, F.col("_to")).otherwise(F.col("src"))).withColumn("lead", lead)
    p = p.join(only("dst", "src", "_from"), "dst", "left").withColumn("z", F.when(tail, F.col("_from")).otherwise(F.col("dst"))).withColumn("tail", tail)
    p = write_once(p.select("src", "dst", "a", "z", "lead", "tail"), "pairs")
    left = F.lit(most) - F.col("lead").cast("int") - F.col("tail").cast("int")
    open_ = p.groupBy("a", "z").agg(F.max(left).alias("left")).filter("left >= 0")
    number = {c: write_once(_numbered(open_.select(c), c), "numbered") for c in "az"}
    named = {c: number[c].select(c, F.col("blk").alias(f"{c}blk"), F.col("bit").alias(f"{c}bit")) for c in "az"}
    open_ = write_once(open_.join(named["a"], "a").join(named["z"], "z"), "open")
    step = {"a": e.select(F.col("src").alias("at"), F.col("dst").alias("to")), "z": e.select(F.col("dst").alias("at"), F.col("src").alias("to"))}
    layers = {c: [write_once(number[c].groupBy("blk", F.col(c).alias("id")).agg(_mask("bit").alias("mask")), "layer")] for c in "az"}
    origins = {c: layers[c][0].count() for c in "az"}
    size, met = dict(origins), []
    few, many = ("a", "z") if origins["a"] <= origins["z"] else ("z", "a")
    for done in range(most + 1):
        m = layers[few][-1].select(F.col("blk").alias(f"{few}blk"), "id", _bits("mask").alias(f"{few}bit")).join(layers[many][-1].select(F.col("blk").alias(f"{many}blk"), "id", "mask"), "id")
        m = m.groupBy(f"{few}blk", f"{few}bit", f"{many}blk").agg(F.bit_or("mask").alias("mask"))
        m = open_.join(m, [f"{few}blk", f"{few}bit", f"{many}blk"]).filter(F.getbit("mask", F.col(f"{many}bit")) == 1)
        m = write_once(m.select("a", "z", "zblk", "zbit", F.lit(done).alias("hops"), F.lit(len(layers["z"]) - 1).alias("deep")), "met")
        met.append(m)
        open_ = write_once(open_.filter(F.col("left") > done).join(m.select("a", "z"), ["a", "z"], "left_anti"), "open")
        if done == most or not open_.limit(1).count():
            break
        c = "a" if size["a"] <= size["z"] else "z"
        who = write_once(open_.groupBy(F.col(f"{c}blk").alias("blk")).agg(_mask(f"{c}bit").alias("open")), "who")
        layers[c].append(_layer(layers[c][-1], step[c], layers[c], who))
        size[c] = layers[c][-1].count()
        if not size[c]:
            break
    found = write_once(_union(met), "found")
    end = found.groupBy("zblk", "zbit").agg(F.max(F.col("hops") - 1).alias("need"), F.max("deep").alias("deep"))
    end = open_.select("zblk", "zbit").distinct().withColumn("open", F.lit(len(layers["z"]) - 1)).join(end, ["zblk", "zbit"], "right")
    end = write_once(end.select("zblk", "zbit", "need", F.greatest("deep", F.coalesce("open", F.lit(0))).alias("deep")), "ends")
    near, longest = list(layers["z"]), found.agg(F.max("hops")).first()[0] or 0
    reached = _union([x.select("id") for x in layers["a"]]).distinct()
    for d in range(1, longest):
        who = write_once(end.filter((F.col("deep") < d) & (F.col("need") >= d)).groupBy(F.col("zblk").alias("blk")).agg(_mask("zbit").alias("open")), "who")
        if who.limit(1).count():
            new = _layer(near[d - 1], step["z"], near[:d], who, reached)
            near[d:] = [near[d].unionByName(new), *near[d + 1 :]] if d < len(near) else [new]
    walk = found.select("a", "z", "zblk", "zbit", "hops", F.col("a").alias("at"), F.array("a").alias("path"))
    ended = [walk.filter("hops = 0").select("a", "z", "hops", "path")]
    walk = walk.filter("hops > 0")
    for done in range(1, longest + 1):  # a walk's next node is its target, or the least that is as near as it has hops left
        last = walk.filter(F.col("hops") == done)
        ended.append(last.select("a", "z", "hops", F.concat("path", F.array("z")).alias("path")))
        walk = write_once(walk.filter(F.col("hops") > done), "walk")
        if done == longest:
            break
        ask = walk.groupBy("at", "zblk", (F.col("hops") - done).alias("need")).agg(_mask("zbit").alias("mask"))
        ask = write_once(ask, "ask").join(e, F.col("at") == F.col("src")).select("at", "zblk", "need", F.col("dst").alias("id"), "mask")
        to = _union([x.select(F.lit(d).alias("need"), F.col("blk").alias("zblk"), "id", F.col("mask").alias("near")) for d, x in enumerate(near) if 0 < d < longest])
        to = ask.join(to, ["need", "zblk", "id"]).withColumn("mask", F.col("mask").bitwiseAND(F.col("near"))).filter("mask <> 0")
        to = to.select("at", "zblk", "need", "id", _bits("mask").alias("zbit")).groupBy("at", "zblk", "need", "zbit").agg(F.min("id").alias("to"))
        walk = walk.withColumn("need", F.col("hops") - done).join(to, ["at", "zblk", "need", "zbit"])
        walk = write_once(walk.select("a", "z", "zblk", "zbit", "hops", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path")), "walk")
    r = p.join(_union(ended), ["a", "z"])
    hops = F.col("hops") + F.col("lead").cast("int") + F.col("tail").cast("int")
    path = F.concat(F.when(F.col("lead"), F.array("src")).otherwise(F.array().cast("array<string>")), "path", F.when(F.col("tail"), F.array("dst")).otherwise(F.array().cast("array<string>")))
    return r.select("src", "dst", hops.cast("int").alias("hops"), path.alias("path")).filter(F.col("hops") <= most)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(id, scc) of the nodes that lie on a cycle: strongly connected components by forward and backward colours.

    Nodes without a way in or out are cut off first, round by round. Then the greatest id that reaches a node is its colour, and the nodes of a colour that its
    root reaches backwards are a component; they leave, and what remains is coloured again.
    """
    e = write_once(edges.select("src", "dst").filter("src <> dst").distinct(), "scc")
    found = [edges.filter("src = dst").select(F.col("src").alias("id"), F.col("src").alias("scc")).distinct().limit(0)]
    for _ in range(most):
        n = e.count()
        while n:  # trim
            kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            kept = write_once(kept, "scc")
            left = kept.count()
            discard(e)
            e, same = kept, left == n
            n = left
            if same:
                break
        if not n:
            return _union(found)
        colour = write_once(e.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id")), "colour")
        while True:
            into = e.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("best"))
            new = write_once(colour.join(into, "id", "left").select("id", F.greatest("colour", F.coalesce("best", "colour")).alias("colour"), (F.col("best") > F.col("colour")).alias("moved")), "colour")
            moved = new.filter("moved").limit(1).count()
            discard(colour)
            colour = new.select("id", "colour")
            if not moved:
                break
        inner = e.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("id").alias("dst"), "colour"), "dst").filter(F.col("c") == F.col("colour")).select("src", "dst", "colour")
        front = write_once(colour.filter(F.col("id") == F.col("colour")), "scc")
        mine = [front]
        while front.limit(1).count():
            back = inner.join(front.select(F.col("id").alias("dst"), F.col("colour").alias("c")), "dst").filter(F.col("c") == F.col("colour")).select(F.col("src").alias("id"), "colour").distinct()
            for m in mine:
                back = back.join(m, ["id", "colour"], "left_anti")
            front = write_once(back, "scc")
            mine.append(front)
        scc = write_once(_union(mine).select("id", F.col("colour").alias("scc")), "scc")
        found.append(scc)
        e = write_once(e.join(scc.select(F.col("id").alias("src")), "src", "left_anti").join(scc.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
    raise RuntimeError("components: no end after the given rounds")


def cycles(edges: DataFrame, longest: int = 8, first: int | None = 10) -> DataFrame:
    """(path) of the ``first`` shortest simple cycles (all, if None) of up to ``longest`` nodes, each once, from its smallest node; of equal lengths the least.

    Only edges within a strongly connected component are looked at. Paths grow by a node a round, through nodes greater than their first; the search ends with the round in which enough are found.
    """
    e = edges.select("src", "dst").distinct()
    loops = e.filter("src = dst").select(F.array("src").alias("path"))
    scc = components(e)
    inner = e.filter("src <> dst").join(scc.select(F.col("id").alias("src"), F.col("scc").alias("c1")), "src").join(scc.select(F.col("id").alias("dst"), F.col("scc").alias("c2")), "dst")
    inner = write_once(inner.filter("c1 = c2").select("src", "dst"), "inner")
    found, paths = write_once(loops, "cycles"), inner.filter("src < dst").select(F.array("src", "dst").alias("path"))
    for _ in range(longest - 1):
        if first is not None and found.limit(first).count() >= first:
            break
        ends = paths.withColumn("last", F.element_at("path", -1)).join(inner, F.col("last") == F.col("src"))
        ends = write_once(ends.select("path", "dst"), "paths")
        found = found.unionByName(ends.filter(F.col("dst") == F.col("path")[0]).select("path"))
        paths = ends.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return found if first is None else found.orderBy(F.size("path"), "path").limit(first)


#: Characters by whose equality the ends of names and runs are joined; longer ends are then compared.
END = 32


def text_scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, name, path, line), edges (type, src, dst)) of (path, text) by plain text: lines that begin with ``def`` or ``class`` define names, and
    ``name(`` anywhere in a file is a call, from the file to the name and back.

    A name without a blank is called where a run of other characters than blanks and parentheses, before a parenthesis, ends in it: distinct runs are joined with the
    names by their ends. Names with blanks are joined by what follows the last one, which is a whole run, and looked for in the texts of the
    files that have it.
    """
    f = files.filter("path IS NOT NULL").select("path", F.coalesce("text", F.lit("")).alias("text"))
    line = f.select("path", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("at", "line"))
    blank = r"[\s\p{Z}\x1c-\x1f\x85]"
    bare = F.regexp_replace("line", f"^{blank}+", "")
    named = line.filter(bare.startswith("def ") | bare.startswith("class ")).select("path", (F.col("at") + 1).alias("line"), F.regexp_replace(F.regexp_extract(bare, "(?s)^[a-z]+ ([^(:]*)", 1), f"^{blank}+|{blank}+$", "").alias("name")).filter("name <> ''")
    named = write_once(named, "defined")
    names = write_once(named.select("name", F.regexp_extract("name", r"([^\s\p{Z}\x1c-\x1f\x85]*)$", 1).alias("tail")).distinct(), "names")
    piece = r"[^\s\p{Z}\x1c-\x1f\x85(]"
    runs = f.filter(F.contains("text", F.lit("("))).select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"((?:(?<!{piece}){piece}++)?)\("), F.lit(1)))).alias("run"))
    runs = write_once(runs.filter("run <> ''"), "runs")
    whole = names.filter("name = tail").select("name", F.right("name", F.lit(END)).alias("end"))
    ends = runs.select("run").distinct().select("run", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("run"), F.lit(END))), lambda i: F.right("run", i))).alias("end"))
    called = ends.join(whole, "end").filter(F.endswith("run", F.col("name"))).select("run", "name").join(runs, "run").select("path", "name")
    odd = names.filter("name <> tail").join(runs, F.col("tail") == F.col("run")).select("path", "name").join(f, "path").filter(F.contains("text", F.concat("name", F.lit("(")))).select("path", "name")
    calls = write_once(called.unionByName(odd).distinct(), "calls")
    edges = calls.select(F.lit("CALLS").alias("type"), F.col("path").alias("src"), F.col("name").alias("dst")).unionByName(calls.select(F.lit("CALLS").alias("type"), F.col("name").alias("src"), F.col("path").alias("dst")))
    nodes = f.select(F.col("path").alias("id"), F.col("path").alias("name"), "path", F.lit(None).cast("int").alias("line")).unionByName(named.select(F.col("name").alias("id"), "name", "path", "line"))
    return nodes, edges
