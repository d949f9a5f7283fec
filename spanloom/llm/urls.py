"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of 8 words of 64 bits; a URL sets one bit in each word of its block. It grows with the list up to
``MOST_BLOCKS`` (72 bytes each), so it may be broadcast. URLs that pass it go to an exact hash
join with the list, which removes the false positives; a list beyond some ten million only lets more of them pass.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is not listed; rows are
judged one by one, so repeated rows and null ids give a row each; a very long url is judged whole; an empty list lists nothing; an empty table gives an
empty result. ``listed`` keeps all columns, whatever their names, but one of the name that it adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 72 bytes: of the least and of the largest filter (72 MB), which is broadcast.
BLOCKS, MOST_BLOCKS = 1 << 16, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, and path without slashes at its end; null without a host."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), "/+$", "")))


def rule_for(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of (verdict, host, path) that fits; of equally long ones that with the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, rh + rp).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit(1), key)
    return [F.shiftright(h, 6 * i).bitwiseAND(63).cast("int") for i in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The blocked Bloom filter of a column: (block, w0 .. w7)."""
    k = F.col(key)
    b = keys.filter(k.isNotNull()).select(_block(k, blocks).alias("block"), *[F.expr("1L").alias("one"), *[x.alias(f"b{i}") for i, x in enumerate(_bits(k))]])
    return b.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(one, b{i})")).alias(f"w{i}") for i in range(8)])


def listed(rows: DataFrame, key: str, names: DataFrame, name: str, blocks: int | None = None, flag: str = "listed") -> DataFrame:
    """``rows`` with a boolean column ``flag``: whether ``key`` is among the ``name`` of ``names``. Without ``blocks``, the filter has a block for every 16
    names, BLOCKS at least and MOST_BLOCKS at most."""
    names = names.select(F.col(name).alias("l_name")).filter("l_name IS NOT NULL").distinct()
    if blocks is None:
        blocks = min(MOST_BLOCKS, max(BLOCKS, names.agg(F.approx_count_distinct("l_name")).first()[0] // 16))
    f = bloom(names, "l_name", blocks).select(F.col("block").alias("l_at"), *[F.col(f"w{i}").alias(f"l_w{i}") for i in range(8)])
    row = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("l_row"), F.col(key).alias("l_key"))
    r = row.withColumn("l_block", _block(F.col("l_key"), blocks)).join(F.broadcast(f), F.col("l_block") == F.col("l_at"), "left")  # at most `blocks` rows
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("l_key"))):
        r = r.withColumn(f"l_b{i}", b)
        hit = hit & (F.expr(f"shiftright(l_w{i}, l_b{i}) & 1L") == 1)
    r = r.withColumn("l_maybe", F.coalesce(hit & F.col("l_key").isNotNull(), F.lit(False))).select("l_row", "l_key", "l_maybe")
    out = lambda x, y: x.select(*[F.col("l_row")[c].alias(c) for c in rows.columns if c.lower() != flag.lower()], y.alias(flag))
    names = names.withColumn("l_in", F.lit(True))
    exact = r.filter("l_maybe").join(names, F.col("l_key") == F.col("l_name"), "left")
    return out(r.filter("NOT l_maybe"), F.lit(False)).unionByName(out(exact, F.coalesce("l_in", F.lit(False))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], names: DataFrame, name: str, id_col: str = "page_id", url_col: str = "url", blocks: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, listed): the longest fitting rule's verdict, else block if listed, else allow."""
    u = F.col(url_col)
    rows = pages.select(F.col(id_col).alias(id_col), host(u).alias("host"), path(u).alias("path"), canonical(u).alias("u_key"))
    r = listed(rows, "u_key", names, name, blocks)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return r.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: First labels of the hosts whose URLs the query's list holds.
LISTED = ["spam-farm", "adult-x", "free-bets"]


def page_verdicts(pages: DataFrame) -> DataFrame:
    """op5: the list holds the canonical URLs of the pages on hosts with a label of LISTED, and those that more than one page has."""
    u = F.col("url")
    labels = F.split(host(u), r"\.")
    names = pages.filter(F.arrays_overlap(labels, F.array(*map(F.lit, LISTED)))).select(canonical(u).alias("name"))
    often = pages.groupBy(canonical(u).alias("name")).agg(F.count("*").alias("n")).filter("n > 1").select("name")
    return judge(pages, RULES, names.unionByName(often), "name")


PAGES_SQL = r"""
WITH a AS (SELECT page_id, url, strpos(url, '://') AS p, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
b AS (SELECT page_id,
  CASE WHEN p > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN p > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM a),
c AS (SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS k,
  list_has_any(string_split(host, '.'), ['spam-farm', 'adult-x', 'free-bets']) AS bad FROM b),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
d AS (SELECT c.*, (SELECT max(struct_pack(n := length(r.h || r.p), m := length(r.h), rule := r.h || r.p, v := r.v)) FROM r
  WHERE (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)) AS x,
  coalesce(k IN (SELECT k FROM c WHERE bad AND k IS NOT NULL UNION ALL SELECT k FROM c WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1), false) AS listed FROM c)
SELECT page_id, host, path, x.rule AS rule, coalesce(x.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM d
"""
