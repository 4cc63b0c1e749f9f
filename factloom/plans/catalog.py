"""The registered queries: every operator on the driver's tables, with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import squeezed
from factloom.operators import graph, relational
from factloom.tables import table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@_query("""select p_partkey, p_name from part where not exists (
    select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and l_quantity >= 49)""")
def unconsumed_antijoin(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return relational.unconsumed(table(spark, d, "part").select("p_partkey", "p_name"), used, ["p_partkey"])


@_query("""select l_suppkey as suppkey, count(*) as uses from lineitem where l_suppkey not in (
    select s_suppkey from supplier where s_acctbal > 0) group by 1""")
def implicit_deps(spark, d):
    used = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("suppkey"))
    return relational.undeclared(used, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("suppkey")), "suppkey")


@_query("""select c_custkey, c_name from customer where c_mktsegment <> 'MACHINERY' and c_custkey not in (
    select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def unused_deps(spark, d):
    used = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.unused(table(spark, d, "customer"), used, "c_custkey", F.col("c_mktsegment") == "MACHINERY").select("c_custkey", "c_name")


@_query("""select p_partkey, p_brand, p_size, latest from part join (
    select p_brand as b, max(p_size) as latest from part group by 1) on p_brand = b where p_size <> latest""")
def outdated_deps(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    latest = part.groupBy("p_brand").agg(F.max("p_size").alias("latest"))
    return relational.outdated(part, latest, "p_brand", "p_size", "latest").select("p_partkey", "p_brand", "p_size", "latest")


@_query("select l_suppkey, count(*) as findings from lineitem where round(l_discount, 2) = 0.1 group by 1")
def count_any(spark, d):
    return relational.count_findings(table(spark, d, "lineitem"), "l_suppkey", F.round("l_discount", 2) == 0.1)


@_query("select l_partkey, count(*) as findings from lineitem where round(l_tax, 2) = 0.08 and l_linestatus = 'O' group by 1")
def count_as(spark, d):
    return relational.count_findings(table(spark, d, "lineitem"), "l_partkey", (F.round("l_tax", 2) == 0.08) & (F.col("l_linestatus") == "O"))


_NATIONS = """select distinct c_nationkey as src, s_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where l_quantity >= 50 and c_nationkey <> s_nationkey"""


def _nation_edges(spark, d) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity >= 50").select("l_orderkey", "l_suppkey")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    buyers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return graph.distinct_edges(big.join(orders, "l_orderkey").join(buyers, "o_custkey").join(sellers, "l_suppkey").select("src", "dst"))


@_query(_NATIONS)
def file_dep_graph(spark, d):
    return _nation_edges(spark, d)


@_query(f"select src as node, count(*) as out_degree from ({_NATIONS}) group by 1")
def edge_fan_out(spark, d):
    return _nation_edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))


_PARTS = """edges as (select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b
    on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
    where a.l_quantity >= 45 and a.l_partkey <> b.l_partkey)"""


def _part_edges(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return graph.distinct_edges(li.where("l_quantity >= 45").withColumnRenamed("l_partkey", "src").join(after, ["l_orderkey", "l_linenumber"]).select("src", "dst"))


def _part_seeds(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_partkey <= 5").select(F.col("p_partkey").alias("node"))


@_query(f"""with recursive {_PARTS}, walk(node, level) as (select p_partkey, 0 from part where p_partkey <= 5
    union select dst, level + 1 from walk join edges on node = src where level < 5)
    select node, min(level) as level from walk group by 1""")
def reach_levels(spark, d):
    return graph.reach_levels(_part_edges(spark, d), _part_seeds(spark, d), 5)


@_query(f"""with recursive {_PARTS}, walk(node, level) as (select p_partkey, 0 from part where p_partkey <= 5
    union select dst, level + 1 from walk join edges on node = src where level < 4),
    bfs as (select node, min(level) as l from walk group by 1)
    select dst as node, max(l) + 1 as level from bfs join edges on node = src where l < 4 group by 1""")
def component_levels_max(spark, d):
    return graph.levels_max(_part_edges(spark, d), _part_seeds(spark, d), 4)


@_query(f"""with recursive edges as ({_NATIONS}), walk(node, level, steps) as (
    select n_nationkey, 0, [cast(n_nationkey as varchar)] from nation where n_nationkey = 0
    union all select dst, level + 1, list_append(steps, cast(dst as varchar)) from walk join edges on node = src
    where level < 2 and not list_contains(steps, cast(dst as varchar)))
    select node, level, array_to_string(steps, ' → ') as path from walk where level > 0""")
def impact_paths(spark, d):
    seed = table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").alias("node"))
    return graph.simple_paths(_nation_edges(spark, d), seed, 2)


@_query("""select case when p_brand like '%#1%' then 'ignored' when p_size > 40 then 'suspicious' else 'unreferenced' end as verdict,
    count(*) as files from part group by 1""")
def classify_when(spark, d):
    verdict = F.when(F.col("p_brand").like("%#1%"), "ignored").when(F.col("p_size") > 40, "suspicious").otherwise("unreferenced")
    return table(spark, d, "part").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("files"))


_PREFIXES = r"""prefixes as (select distinct regexp_extract(url, '^(https?://[^/]+)', 1) as root from pages
    union select distinct regexp_extract(url, '^(https?://[^/]+/[^/]+)', 1) from pages)"""


@_query(f"""with {_PREFIXES} select page_id, url, arg_max(root, length(root)) as root from pages join prefixes
    on url = root or starts_with(url, root || '/') where root <> '' group by 1, 2""")
def longest_prefix(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    roots = pages.select(F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("root")).union(pages.select(F.regexp_extract("url", r"^(https?://[^/]+/[^/]+)", 1)))
    return relational.longest_prefix(pages, "url", roots.where("root <> ''"), "root")


@_query("""select p_partkey, prefix from part join (select distinct substr(p_brand, 1, 7) as prefix from part where p_size <= 25)
    on starts_with(p_brand, prefix)""")
def prefix_join(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    prefixes = part.where("p_size <= 25").select(F.substring("p_brand", 1, 7).alias("prefix"))
    return relational.starts_with_join(part, "p_brand", prefixes, "prefix", 7).select("p_partkey", "prefix")


@_query("""select o_orderkey, count(*) as hits from lineitem join orders on l_orderkey = o_orderkey
    where l_shipdate between o_orderdate and o_orderdate + interval 10 day group by 1""")
def interval_join(spark, d):
    spans = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("low"), (F.col("o_orderdate") + F.expr("interval 10 days")).alias("high"))
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return relational.inside_interval(points, spans, ["o_orderkey"], "l_shipdate", "low", "high").groupBy("o_orderkey").agg(F.count("*").alias("hits"))


@_query("""select page_id, href from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages)""")
def href_edges(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@_query("select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(*) as pages from pages group by 1")
def host_group(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("pages"))


@_query("""select doc_id, nth as line, length(l) as width from (select doc_id, unnest(string_split(text, chr(10))) as l,
    generate_subscripts(string_split(text, chr(10)), 1) as nth from documents) where l like '%the%'""")
def text_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return lines.where(F.col("l").like("%the%")).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), F.length("l").cast("long").alias("width"))


@_query(r"select doc_id, length(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) as width from documents")
def whitespace_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(squeezed(F.col("text"))).cast("long").alias("width"))


@_query("select cast(json_extract(props, '$.k') as bigint) as k, count(*) as events from events group by 1")
def json_field(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("events"))


@_query("""select event_id, cast(sum(case when event_type <> 'error' then 1 else 0 end)
    over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as line from events""")
def diff_line_numbers(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return relational.running_number(events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") != "error", "line").select("event_id", "line")


@_query("""select l_partkey as partkey from lineitem where l_returnflag = 'A' and l_quantity >= 45
    except select l_partkey from lineitem where l_returnflag = 'N' and l_quantity >= 45""")
def set_difference(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity >= 45")
    pick = lambda flag: li.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("partkey")).distinct()
    return pick("A").join(pick("N"), "partkey", "left_anti")


@_query("select o_custkey as custkey, string_agg(p, ',' order by p) as priorities from (select distinct o_custkey, o_orderpriority as p from orders) group by 1")
def merged_imports(spark, d):
    return relational.merged(table(spark, d, "orders").withColumnRenamed("o_custkey", "custkey"), "custkey", "o_orderpriority", "priorities")


@_query("""select p_type, p_partkey, p_size from part qualify row_number() over (partition by p_type order by p_size, p_partkey) = 1""")
def first_match(spark, d):
    return relational.first_match(table(spark, d, "part").select("p_type", "p_partkey", "p_size"), ["p_type"], [F.col("p_size"), F.col("p_partkey")])


@_query("""with recursive flow as (select distinct a.l_orderkey as o, a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b
    on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where round(b.l_discount, 2) >= 0.05),
    walk(o, node, level) as (select l_orderkey, l_partkey, 0 from lineitem where l_returnflag = 'R' and l_quantity >= 49
    union select flow.o, dst, level + 1 from walk join flow on walk.o = flow.o and node = src where level < 5)
    select distinct o as orderkey, node from walk""")
def taint_fixpoint(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_quantity")
    after = li.where("round(l_discount, 2) >= 0.05").select("orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    flow = li.select("orderkey", "l_linenumber", F.col("l_partkey").alias("src")).join(after, ["orderkey", "l_linenumber"])
    seeds = li.where("l_returnflag = 'R' and l_quantity >= 49").select("orderkey", F.col("l_partkey").alias("node"))
    return graph.spread(flow, seeds, ["orderkey"], rounds=5)


@_query("""with recursive chain as (select p_partkey as node, lag(p_partkey) over (partition by p_brand order by p_partkey) as parent, p_size from part),
    walk(node, origin, hops) as (select node, node, 0 from chain where p_size <= 5
    union all select c.node, w.origin, w.hops + 1 from walk w join chain c on c.parent = w.node where c.p_size > 5 and w.hops < 10)
    select node, origin, hops from walk""")
def origin_chain(spark, d):
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    chain = table(spark, d, "part").select(F.col("p_partkey").alias("node"), before.alias("parent"), "p_size")
    return graph.follow_origin(chain.where("p_size <= 5"), chain.where("p_size > 5 and parent is not null"), 10)


@_query(r"""select w as word, count(*) as uses from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark) where length(w) > 6 group by 1""")
def word_facts(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word"))
    return words.where(F.length("word") > 6).groupBy("word").agg(F.count("*").alias("uses"))
