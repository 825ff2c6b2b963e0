"""Page graph: nodes, wikilink, tag-shared and semantic edges, degrees, neighbourhoods, checks, layout.

Edges are ``src, dst, edge_type, score, shared_tags``; undirected families are written once, smaller end first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from lorebase.functions.text import strip, wikilinks
from lorebase.operators.search import DOMAIN_TAGS, first_type, parent_folder, stem, tag_list


def build_nodes(pages: DataFrame) -> DataFrame:
    """``id, path, title, tags, domain, type_tag, summary, updated`` with defaults; one node per path.

    Two paths of one file name share an id; ``paths_of_id`` says how many, so that collisions are visible.
    """
    tags = tag_list(F.col("tags"))
    n = pages.select(stem(F.col("path")).alias("id"), "path", F.coalesce("title", stem(F.col("path"))).alias("title"), tags.alias("tags"), parent_folder(F.col("path")).alias("domain"), first_type(tags).alias("type_tag"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("updated", F.lit("")).alias("updated"))
    return n.withColumn("paths_of_id", F.count(F.lit(1)).over(Window.partitionBy("id")))


def link_edges(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct directed ``src, dst`` of ``id, content`` rows; targets are resolved by file name, self links dropped."""
    target = F.explode(wikilinks(F.col("content")))
    links = texts.select(F.col("id").alias("src"), target.alias("dst")).select("src", F.trim("dst").alias("dst")).where("src <> dst").distinct()
    return links.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", F.lit("wikilink").alias("edge_type"))


def named_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links ``src, target``, those that lead to a page ``src, target, dst``) of the wikilinks in ``path, title, content``.

    Pages are known by path. A target means every page whose title or file name it is, in any case; a file name may have
    hyphens for its blanks. Links of a page to itself lead to a page, too.
    """
    p = pages.where("path IS NOT NULL")
    target = strip(F.col("raw"))
    links = p.select(F.col("path").alias("src"), F.explode(wikilinks(F.col("content"))).alias("raw")).select("src", target.alias("target")).where("target <> ''").distinct()
    name = F.explode(F.array(F.lower(strip(F.col("title"))), F.lower(stem(F.col("path")))))
    names = p.select(name.alias("name"), F.col("path").alias("dst")).where("name <> ''").distinct()
    keys = links.withColumn("name", F.explode(F.array_distinct(F.array(F.lower("target"), F.replace(F.lower("target"), F.lit(" "), F.lit("-"))))))
    return links, keys.join(names, "name").select("src", "target", "dst").distinct()


#: A block has so many nodes of a tag at most, or their share of one in so many; folders with one in FOLDERS of a tag's nodes have blocks of their own.
BLOCK, BLOCKS, FOLDERS = 4096, 32, 64


def tag_edges(nodes: DataFrame, tags: tuple[str, ...] = DOMAIN_TAGS) -> DataFrame:
    """Pairs of nodes ``id, domain, tags`` of different folders with common domain tags; an id may have several rows.

    The result is every such pair, so it grows with the square of a tag's pages. A pair is made once, at the least tag it
    shares, so only nodes are shuffled and never pairs.
    """
    pairs, shared = _tag_pairs(nodes.select("id", "domain", "tags"), tags)
    return pairs.select(*_ends(), shared.alias("shared_tags"))


def tag_edge_visibility(nodes: DataFrame, chosen: Column, tags: tuple[str, ...] = DOMAIN_TAGS) -> DataFrame:
    """``edge_visibility`` of ``tag_edges`` for the nodes that are ``chosen``: they are marked before they are paired, so no pair is looked up."""
    pairs, _ = _tag_pairs(nodes.select("id", "domain", "tags", F.coalesce(chosen, F.lit(False)).alias("chosen")), tags, "chosen")
    return pairs.select(*_ends(), (~(F.col("a.chosen") | F.col("b.chosen"))).alias("hidden"))


def _ends() -> tuple[Column, Column]:
    return F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst")


def _tag_pairs(nodes: DataFrame, tags: tuple[str, ...], *marks: str) -> tuple[DataFrame, Column]:
    """(the pairs of ``tag_edges`` as ``a`` and ``b``, each with the columns ``marks``, the tags they share).

    The nodes of a tag are cut into blocks, and a join brings each two blocks together. Folders with many of them
    have blocks of their own, which need not meet each other; all other nodes of the tag share the first blocks.
    """
    common = F.explode(F.array_distinct(F.filter("tags", lambda t: t.isin(*tags)))).alias("tag")
    rows = nodes.where("id IS NOT NULL AND domain IS NOT NULL").select("id", "domain", *marks, common)
    # a tag that an id has in several folders has no folder: it meets those of all folders
    rows = rows.groupBy("id", "tag").agg(F.min("domain").alias("domain"), F.max("domain").alias("last"), *[F.max(m).alias(m) for m in marks])
    each = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tag", F.when(F.col("domain") == F.col("last"), F.col("domain")).alias("domain")))).alias("tags"), *[F.max(m).alias(m) for m in marks])
    each = each.select("*", F.explode("tags").alias("at")).select("id", "tags", *marks, "at.tag", "at.domain")

    counts = each.groupBy("tag", "domain").agg(F.count(F.lit(1)).alias("n"))
    block = F.greatest(F.lit(BLOCK), F.ceil(F.col("total") / BLOCKS))
    sized = counts.join(F.broadcast(counts.groupBy("tag").agg(F.sum("n").alias("total"))), "tag").withColumn("block", block)
    large = F.when(F.col("domain").isNotNull() & (F.col("n") * FOLDERS > F.greatest("total", F.lit(BLOCK))), F.struct("domain", "n"))
    pools, folders, cells = [], [], 0
    for r in sized.groupBy("tag").agg(F.max("total").alias("total"), F.max("block").alias("block"), F.collect_list(large).alias("large")).collect():
        first = pool = max(1, -(-(r["total"] - sum(x["n"] for x in r["large"])) // r["block"]))
        for x in r["large"]:
            folders.append((r["tag"], x["domain"], first, own := -(-x["n"] // r["block"])))
            first, cells = first + own, cells - own * (own + 1) // 2
        pools.append((r["tag"], pool, first))
        cells += first * (first + 1) // 2

    spark = nodes.sparkSession
    pools = F.broadcast(spark.createDataFrame(pools, "tag string, pool int, blocks int"))
    folders = F.broadcast(spark.createDataFrame(folders, "tag string, domain string, first int, own int"))
    number = F.coalesce("first", F.lit(0)) + F.pmod(F.xxhash64("id"), F.coalesce("own", "pool")).cast("int")
    placed = each.join(pools, "tag").join(folders, ["tag", "domain"], "left").withColumn("block", number)
    apart = lambda o: F.col("first").isNull() | (o < F.col("first")) | (o >= F.col("first") + F.col("own"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), apart)
    kept = "id", "tag", "domain", "tags", *marks
    x = placed.select(*kept, F.col("block").alias("p"), F.explode(F.filter(others, lambda o: o >= F.col("block"))).alias("q"))
    y = placed.select(*kept, F.explode(F.filter(others, lambda o: o <= F.col("block"))).alias("p"), F.col("block").alias("q"))
    # a number, as else few and small partitions would be joined into one, which would make all pairs
    width = max(1, min(cells, 8 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
    a, b = (d.repartition(width, "tag", "p", "q").alias(n) for d, n in ((x, "a"), (y, "b")))

    both = F.filter("a.tags", lambda s: F.exists("b.tags", lambda t: (s["tag"] == t["tag"]) & F.coalesce(s["domain"] != t["domain"], F.lit(True))))
    single = (F.size("a.tags") == 1) | (F.size("b.tags") == 1)
    shared = F.when(single, F.array("a.tag")).otherwise(F.transform(both, lambda s: s["tag"]))
    meet = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("tag", "p", "q")]
    once = (F.col("a.p") != F.col("a.q")) | (F.col("a.id") < F.col("b.id"))
    least = F.when(single, F.lit(True)).otherwise(F.get(both, 0)["tag"] == F.col("a.tag"))
    differ = F.coalesce(F.col("a.domain") != F.col("b.domain"), F.lit(True))
    return a.join(b, [*meet, once, differ, least]), shared


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_edges(vectors: DataFrame, threshold: float = 0.65, key: str = "id", vector: str = "vector", blocks: int | None = None) -> DataFrame:
    """Exact pairs of unit vectors with a cosine of at least ``threshold``: ``src, dst, score`` (3 digits).

    Vectors are cut into ``blocks`` blocks; each pair of blocks is one matrix product in one task, so memory is bounded
    by two blocks; without ``blocks`` there are as many as the rows need at 2048 rows a block, six at least. Null vectors and keys have no edges. This compares
    everything with everything; ``similar_by_projection`` is for tables too large for that.
    """
    import numpy as np
    import pandas as pd

    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
    blocks = blocks or max(6, -(-rows.count() // 2048))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))))
    spread = rows.select("id", "v", "block", cells.alias("cell")).select("id", "v", "block", "cell.x", "cell.y")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left, right = pdf[pdf["block"] == x], pdf[pdf["block"] == y]
        out = {"src": [], "dst": [], "score": []}
        if len(left) and len(right):
            a, b = np.array(left["v"].tolist(), np.float64), np.array(right["v"].tolist(), np.float64)
            for start in range(0, len(a), 1024):
                i, j = np.nonzero((s := a[start : start + 1024] @ b.T) >= threshold)
                for p, q in zip(i, j):
                    u, v = left["id"].iloc[start + p], right["id"].iloc[q]
                    if u < v or (x != y and u != v):
                        out["src"].append(min(u, v)), out["dst"].append(max(u, v)), out["score"].append(round(float(s[p, q]), 3))
        return pd.DataFrame({"src": pd.Series(out["src"], dtype=object), "dst": pd.Series(out["dst"], dtype=object), "score": pd.Series(out["score"], dtype=float)})

    return spread.groupBy("x", "y").applyInPandas(product, "src string, dst string, score double")


def similar_by_projection(vectors: DataFrame, threshold: float = 0.65, key: str = "id", vector: str = "vector", width: float = 0.6, tables: int = 24) -> DataFrame:
    """Approximate ``semantic_edges`` by random projections: candidates share a bucket, each is verified exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=7).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, (2 - 2 * threshold) ** 0.5 + 1e-9, "d").where("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("src"), F.col("datasetB.id").alias("dst"), F.bround(1 - F.col("d") * F.col("d") / 2, 3).alias("score"))


def all_edges(*families: DataFrame) -> DataFrame:
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, degree, size``: both directions, repeated and self edges counted; size is 25 + 5 per edge, at most 75."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return _sized(nodes.select("id").distinct().join(ends, "id", "left"))


def _sized(d: DataFrame) -> DataFrame:
    d = d.select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return d.withColumn("size", F.least(F.greatest(25 + 5 * F.col("degree"), F.lit(25)), F.lit(75)))


def tag_degrees(nodes: DataFrame, tags: tuple[str, ...] = DOMAIN_TAGS) -> DataFrame:
    """``degrees`` of ``tag_edges``, without the edges; one row an id.

    Nodes of one set of tags meet the same nodes: all whose set has a tag in common with theirs, less those of their own
    folder. Both come from the counts of sets and folders.
    """
    n = nodes.select("id", "domain", F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isin(*tags)))).alias("set"))
    counts = n.where("id IS NOT NULL AND domain IS NOT NULL AND size(set) > 0").groupBy("domain", "set").agg(F.count(F.lit(1)).alias("n"))

    def met(sets: DataFrame, *keys: str) -> DataFrame:
        """For each set, ``n`` of the sets that have a tag in common with it: two sets meet at the least such tag."""
        each = sets.select("*", F.explode("set").alias("tag"))
        a, b = each.alias("a"), each.alias("b")
        least = F.array_min(F.array_intersect("a.set", "b.set")) == F.col("a.tag")
        pairs = a.join(b, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "tag")], least])
        return pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in (*keys, "set")]).agg(F.sum("b.n").alias("n"))

    everywhere = met(counts.groupBy("set").agg(F.sum("n").alias("n"))).withColumnRenamed("n", "everywhere")
    degree = met(counts, "domain").join(everywhere, "set").select("domain", "set", (F.col("everywhere") - F.col("n")).alias("degree"))
    return _sized(n.join(degree, ["domain", "set"], "left").withColumn("degree", F.when(F.col("id").isNotNull(), F.col("degree"))))


def neighbourhood(edges: DataFrame, seed: DataFrame, hops: int) -> DataFrame:
    """``id`` of the seed and of all nodes at most ``hops`` edges away, edges taken in both directions."""
    both, reached = symmetric(edges), seed.select("id").distinct()
    for _ in range(hops):
        step = both.join(reached, both["src"] == reached["id"], "left_semi").select(F.col("dst").alias("id"))
        reached = reached.union(step).distinct()
    return reached


def focus(structural: DataFrame, semantic: DataFrame, seed: DataFrame) -> DataFrame:
    """Two structural hops and one semantic hop around the seed."""
    return neighbourhood(structural, seed, 2).union(neighbourhood(semantic, seed, 1)).distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    keep = ids.select("id").distinct()
    return edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def edge_visibility(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``hidden``: neither end is among ``ids``."""
    keep = ids.select("id").distinct()
    e = edges.join(keep.select(F.col("id").alias("_s")), F.col("src") == F.col("_s"), "left").join(keep.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left")
    return e.select(*edges.columns, (F.col("_s").isNull() & F.col("_d").isNull()).alias("hidden"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id").distinct()


def dead_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    return links.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()


def stale(pages: DataFrame, today: str, days: int = 60) -> DataFrame:
    """Pages whose ``updated`` is a day, with hyphens or slashes, more than ``days`` before ``today``; other texts are no day."""
    text = strip(F.col("updated"))
    day = F.when(text.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), F.replace(text, F.lit("/"), F.lit("-")).try_cast("date"))
    return pages.where(F.date_diff(F.lit(today).cast("date"), day) > days).select("path", day.cast("string").alias("updated"))


def scaled_layout(points: DataFrame, width: float = 1000.0, height: float = 750.0) -> DataFrame:
    """``id, x, y`` scaled to ±width and ±height by the extremes of the table; one point or equal values sit at 0.

    The extremes are one row, joined by broadcast.
    """
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda c, half: F.coalesce(F.bround((F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) * 2 - 1) * half, 1), F.lit(0.0))
    return points.join(F.broadcast(ends), F.lit(True)).select("id", at("x", width).alias("x"), at("y", height).alias("y"))


def pca_layout(vectors: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """Two principal components in place of a neighbour embedding, scaled; fewer than four rows lie on a line."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    if rows.limit(4).count() < 4:
        return rows.select("id", ((F.row_number().over(Window.orderBy("id")) - 1) * 220.0).alias("x"), F.lit(0.0).alias("y"))
    flat = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("id", vector_to_array("p").alias("p"))
    return scaled_layout(flat.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))



# fixed values: colour of a domain, shape of a type
DEFAULT_COLOUR, DEFAULT_SHAPE = "#9E9E9E", "ellipse"


def title_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes ``title, degree, size``, edges ``source, target``) of pages known by their titles.

    A link counts for its target's degree, and for its page's if its target is among the pages, as often as it is written;
    edges are distinct and lead to another page. Titles that several pages share are one node.
    """
    named = pages.select(F.coalesce("title", stem(F.col("path"))).alias("title"), F.col("content"))
    titles = named.select("title").distinct()
    links = named.select(F.col("title").alias("source"), F.explode(wikilinks(F.col("content"))).alias("target")).withColumn("target", F.trim("target"))
    links = links.join(titles.select(F.col("title").alias("target")), "target", "left_semi")
    ends = links.select(F.explode(F.array("source", "target")).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("degree"))
    nodes = titles.join(ends, "title", "left").select("title", F.coalesce("degree", F.lit(0)).alias("degree"))
    return nodes.withColumn("size", F.least(F.greatest(25 + 5 * F.col("degree"), F.lit(25)), F.lit(75))), links.where("source <> target").select("source", "target").distinct()


def styled(nodes: DataFrame, colours: dict[str, str], shapes: dict[str, str]) -> DataFrame:
    """Nodes ``domain, type_tag`` with ``colour`` and ``shape`` from the given maps, else the defaults."""
    chosen = lambda m, c, other: F.coalesce(F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(c)], F.lit(other)) if m else F.lit(other)
    return nodes.withColumns({"colour": chosen(colours, "domain", DEFAULT_COLOUR), "shape": chosen(shapes, "type_tag", DEFAULT_SHAPE)})


def conflicts(pages: DataFrame) -> DataFrame:
    """``path, unresolved``: pages that record conflicts nobody has decided, with their number."""
    # fixed value: the line that says so
    open_ = F.size(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?m)^\*\*Status:\*\*\s*Unresolved"), 0))
    return pages.select("path", open_.alias("unresolved")).where("unresolved > 0")


def uncited(pages: DataFrame) -> DataFrame:
    """Pages whose front matter names no source."""
    return pages.where(~F.coalesce(F.col("content").rlike(r"(?m)^sources:\s*(\r?\n\s*-|\[.+\])"), F.lit(False))).select("path")
