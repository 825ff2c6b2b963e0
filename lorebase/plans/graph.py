"""Queries: nodes, edges, neighbourhoods, checks."""

from pyspark.sql import functions as F

from lorebase.operators import graph as G
from lorebase.plans.catalogue import query, table
from lorebase.plans.search import CURRENT, TAGS, pages

DOMAINS = "('langgraph','rag','adk','mcp','memory','eval','infra','deep-agents','patterns','meta','projects')"
NODE = """node AS (SELECT id, any_value(data.domain[1]) AS domain, list_sort(list_distinct(flatten(list(coalesce(data.tags, []))))) AS tags FROM nodes GROUP BY id)"""
TAG_EDGES = f"""each AS (SELECT id, domain, unnest(list_distinct(list_filter(tags, lambda t: t IN {DOMAINS}))) AS tag FROM node),
tag_edge AS (SELECT a.id AS src, b.id AS dst, list_sort(list_distinct(list(a.tag))) AS shared FROM each a JOIN each b ON a.tag = b.tag AND a.id < b.id AND a.domain <> b.domain GROUP BY ALL)"""


def nodes(spark, folder):
    rows = table(spark, folder, "nodes").select("id", F.col("data.domain")[0].alias("domain"), F.coalesce("data.tags", F.array().cast("array<string>")).alias("tags"))
    return rows.groupBy("id").agg(F.any_value("domain").alias("domain"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))


@query(f"WITH {NODE}, {TAG_EDGES} SELECT src, dst, array_to_string(shared, ' ') AS shared_tags FROM tag_edge")
def tag_shared_edges(spark, folder):
    return G.tag_edges(nodes(spark, folder)).select("src", "dst", F.array_join("shared_tags", " ").alias("shared_tags"))


@query(f"WITH {NODE}, {TAG_EDGES}, e AS (SELECT src AS id FROM tag_edge UNION ALL SELECT dst FROM tag_edge), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id) SELECT node.id, coalesce(degree, 0) AS degree, least(greatest(25 + 5 * coalesce(degree, 0), 25), 75) AS size FROM node LEFT JOIN d ON d.id = node.id")
def node_degree(spark, folder):
    return G.tag_degrees(nodes(spark, folder))


# links of other shapes (aliases, parts) than the pages have, made from lineitem; page_links and page_dead_links read the pages
LINKS = """txt AS (SELECT id, '[[' || string_agg(t, ']] and [[' ORDER BY t) || ']]' AS content FROM (SELECT DISTINCT l_suppkey::VARCHAR AS id, CASE WHEN l_linenumber = 1 THEN l_partkey::VARCHAR || '|alias' WHEN l_linenumber = 2 THEN l_partkey::VARCHAR || '#part' ELSE l_partkey::VARCHAR END AS t FROM lineitem) GROUP BY id)"""


def _texts(spark, folder):
    t = F.col("l_partkey").cast("string")
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("id"), F.when(F.col("l_linenumber") == 1, F.concat(t, F.lit("|alias"))).when(F.col("l_linenumber") == 2, F.concat(t, F.lit("#part"))).otherwise(t).alias("t")).distinct()
    return rows.groupBy("id").agg(F.concat(F.lit("[["), F.array_join(F.array_sort(F.collect_list("t")), "]] and [["), F.lit("]]")).alias("content"))


_RAW = LINKS + r""", raw AS (SELECT DISTINCT id AS src, unnest(regexp_extract_all(content, '\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]', 1)) AS dst FROM txt)"""


@query(f"WITH {_RAW} SELECT src, dst, 'wikilink' AS edge_type FROM raw WHERE src <> dst AND dst IN (SELECT id FROM txt)")
def wikilink_edges(spark, folder):
    t = _texts(spark, folder)
    return G.link_edges(t, t)


@query(f"WITH {_RAW} SELECT src, dst FROM raw WHERE dst NOT IN (SELECT id FROM txt)")
def lint_dead_links(spark, folder):
    from lorebase.functions.text import wikilinks

    t = _texts(spark, folder)
    return G.dead_links(t.select(F.col("id").alias("src"), F.explode(wikilinks(F.col("content"))).alias("dst")), t)


NAMED = CURRENT + r""", p AS (SELECT * FROM page WHERE path IS NOT NULL), raw AS (SELECT path AS src, unnest(regexp_extract_all(content, '\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]', 1)) AS raw FROM p),
link AS (SELECT DISTINCT src, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS target FROM raw WHERE NOT regexp_full_match(raw, '\s*')),
name AS (SELECT lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) AS name, path FROM p UNION SELECT lower(regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')), path FROM p),
hit AS (SELECT src, target, path AS dst FROM link JOIN name ON name <> '' AND name IN (lower(target), replace(lower(target), ' ', '-')))"""


@query(f"WITH {NAMED} SELECT DISTINCT src, dst, 'wikilink' AS edge_type FROM hit WHERE src <> dst")
def page_links(spark, folder):
    _, hits = G.named_links(pages(spark, folder))
    return hits.where("src <> dst").select("src", "dst").distinct().withColumn("edge_type", F.lit("wikilink"))


@query(f"WITH {NAMED} SELECT src, target AS dst FROM link WHERE (src, target) NOT IN (SELECT (src, target) FROM hit)")
def page_dead_links(spark, folder):
    links, hits = G.named_links(pages(spark, folder))
    return links.join(hits, ["src", "target"], "left_anti").select("src", F.col("target").alias("dst"))


@query("SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def lint_orphans(spark, folder):
    n = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return G.orphans(n, table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("dst")))


@query(f"WITH {CURRENT}, d AS (SELECT path, CASE WHEN regexp_matches(trim(updated), '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}$') THEN try_cast(replace(trim(updated), '/', '-') AS DATE) END AS day FROM page) SELECT path, day::VARCHAR AS updated FROM d WHERE date_diff('day', day, DATE '2026-10-01') > 60")
def lint_stale(spark, folder):
    return G.stale(pages(spark, folder), "2026-10-01")


@query(f"WITH {CURRENT} SELECT path FROM page WHERE NOT coalesce(regexp_matches(content, '(?m)^sources:\\s*(\\r?\\n\\s*-|\\[.+\\])'), false)")
def lint_uncited(spark, folder):
    return G.uncited(pages(spark, folder))


@query(f"WITH {CURRENT} SELECT path, len(regexp_extract_all(coalesce(content, ''), '(?m)^\\*\\*Status:\\*\\*\\s*Unresolved'))::INT AS unresolved FROM page WHERE regexp_matches(content, '(?m)^\\*\\*Status:\\*\\*\\s*Unresolved')")
def lint_conflicts(spark, folder):
    return G.conflicts(pages(spark, folder))


TITLED = f"""WITH {CURRENT}, p AS (SELECT coalesce(title, regexp_extract(path, '([^/]*)\\.md$', 1)) AS title, content FROM page),
link AS (SELECT title AS source, trim(unnest(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]+)?\\]\\]', 1))) AS target FROM p),
hit AS (SELECT * FROM link WHERE target IN (SELECT title FROM p))"""


@query(f"{TITLED} SELECT DISTINCT source, target FROM hit WHERE source <> target")
def title_edges(spark, folder):
    return G.title_graph(pages(spark, folder))[1]


@query(f"{TITLED}, e AS (SELECT source AS title FROM hit UNION ALL SELECT target FROM hit), d AS (SELECT title, count(*) AS degree FROM e GROUP BY 1) SELECT p.title, coalesce(degree, 0) AS degree, least(greatest(25 + 5 * coalesce(degree, 0), 25), 75) AS size FROM (SELECT DISTINCT title FROM p) p LEFT JOIN d USING (title)")
def title_nodes(spark, folder):
    return G.title_graph(pages(spark, folder))[0]


_SEED = "seed AS (SELECT id FROM node WHERE list_contains(tags, 'bm25'))"
_SYM = "sym AS (SELECT src, dst FROM tag_edge UNION SELECT dst, src FROM tag_edge)"
_ONE = "one AS (SELECT id FROM seed UNION SELECT dst FROM sym WHERE src IN (SELECT id FROM seed))"


def _seeded():
    return F.array_contains("tags", "bm25")


def _seed(n):
    return n.where(_seeded()).select("id")


@query(f"WITH {NODE}, {TAG_EDGES}, {_SEED}, {_SYM}, {_ONE} SELECT id FROM one")
def filter_expand(spark, folder):
    n = nodes(spark, folder)
    return G.neighbourhood(G.tag_edges(n), _seed(n), 1)


@query(f"WITH {NODE}, {TAG_EDGES}, l AS (SELECT id AS src, 'folder ' || domain AS dst FROM node WHERE domain IS NOT NULL), sym AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), seed AS (SELECT min(id) AS id FROM node), one AS (SELECT id FROM seed UNION SELECT dst FROM sym WHERE src IN (SELECT id FROM seed)), two AS (SELECT id FROM one UNION SELECT dst FROM sym WHERE src IN (SELECT id FROM one)) SELECT id FROM two UNION SELECT dst FROM tag_edge WHERE src IN (SELECT id FROM seed) UNION SELECT src FROM tag_edge WHERE dst IN (SELECT id FROM seed)")
def k_hop_focus(spark, folder):
    """The first node, its folder's nodes, and the nodes that share a tag with it."""
    n = nodes(spark, folder)
    inside = n.where("domain IS NOT NULL").select(F.col("id").alias("src"), F.concat(F.lit("folder "), F.col("domain")).alias("dst"))
    return G.focus(inside, G.tag_edges(n).select("src", "dst"), n.agg(F.min("id").alias("id")))


@query("""WITH l AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem), sym AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l),
seed AS (SELECT 'c' || min(o_custkey) AS id FROM orders), one AS (SELECT id FROM seed UNION SELECT dst FROM sym WHERE src IN (SELECT id FROM seed)), two AS (SELECT id FROM one UNION SELECT dst FROM sym WHERE src IN (SELECT id FROM one)),
sem AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer) SELECT id FROM two UNION SELECT dst FROM sem WHERE src IN (SELECT id FROM seed)""")
def order_focus(spark, folder):
    """The first customer's orders and their suppliers, and the customer's nation, on whole tables and unfolded keys."""
    name = lambda c, kind: F.concat(F.lit(kind), F.col(c))
    o, l, c = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    links = o.select(name("o_orderkey", "o").alias("src"), name("o_custkey", "c").alias("dst")).union(l.select(name("l_orderkey", "o"), name("l_suppkey", "s")))
    return G.focus(links, c.select(name("c_custkey", "c").alias("src"), name("c_nationkey", "n").alias("dst")), o.agg(F.min("o_custkey").alias("c")).select(name("c", "c").alias("id")))


@query(f"WITH {NODE}, {TAG_EDGES}, {_SEED} SELECT src, dst FROM tag_edge WHERE src IN (SELECT id FROM seed) AND dst IN (SELECT id FROM seed)")
def induced_subgraph(spark, folder):
    n = nodes(spark, folder)
    return G.induced(G.tag_edges(n).select("src", "dst"), _seed(n))


@query(f"WITH {NODE}, {TAG_EDGES}, {_SEED} SELECT src, dst, src NOT IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed) AS hidden FROM tag_edge")
def edge_visibility(spark, folder):
    return G.tag_edge_visibility(nodes(spark, folder), _seeded())


@query(f"WITH {CURRENT} SELECT regexp_extract(path, '([^/]*)\\.md$', 1) AS id, path, split_part(path, '/', -2) AS domain, len({TAGS}) AS n_tags, count(*) OVER (PARTITION BY regexp_extract(path, '([^/]*)\\.md$', 1)) AS paths_of_id FROM page")
def graph_nodes(spark, folder):
    return G.build_nodes(pages(spark, folder)).select("id", "path", "domain", F.size("tags").cast("long").alias("n_tags"), "paths_of_id")


@query("""WITH p AS (SELECT DISTINCT id, position.x AS x, position.y AS y FROM nodes WHERE position IS NOT NULL), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p)
SELECT id, round_even(((x - lx) / (hx - lx) * 2 - 1) * 1000, 1) AS x, round_even(((y - ly) / (hy - ly) * 2 - 1) * 750, 1) AS y FROM p, e""")
def minmax_layout(spark, folder):
    return G.scaled_layout(table(spark, folder, "nodes").where("position IS NOT NULL").select("id", "position.x", "position.y").distinct())


@query("""WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.id AS src, b.id AS dst, round_even(list_dot_product(a.v, b.v), 3) AS score FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.3""")
def semantic_edges(spark, folder):
    return G.semantic_edges(table(spark, folder, "embeddings"), 0.3, "vec_id", "embedding")
