"""The graph of citations between articles of a law family (act, decree, rule).

References are found by a pattern over the text, resolved within the family of the citing law, and folded to edges:
CITES within one law, DELEGATES between levels, always from the higher to the lower one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexstrata.functions.text import article_code, without_heading
from lexstrata.session import spread

# Ranks of the levels, and the words that name the citing law or a level of its family.
RANKS = {"법률": 1, "시행령": 2, "시행규칙": 3}
SELF_WORDS = ("이법", "같은법", "이영", "같은영")
GENERIC = "이\\s?법|같은\\s?법|이\\s?영|같은\\s?영|시행규칙|시행령|[가-힣]{2,12}법|법|영|규칙"
ARTICLE = "제(\\d+)조(?:의(\\d+))?"


def law_families(laws: DataFrame) -> DataFrame:
    """(law_id, law_name, hierarchy, rank, base, act_id, decree_id, rule_id): laws that share their act's name.

    Of several laws of one name and level the one with the least id stands for it; repeated rows count once.
    """
    rows = laws.select("law_id", "law_name", "hierarchy").distinct().where(F.col("hierarchy").isin(*RANKS))
    rows = rows.withColumn("base", F.regexp_replace("law_name", " (시행령|시행규칙)$", ""))
    of = lambda level: F.min(F.when(F.col("hierarchy") == level, F.col("law_id")))
    family = rows.groupBy("base").agg(of("법률").alias("act_id"), of("시행령").alias("decree_id"), of("시행규칙").alias("rule_id"))
    rank = F.when(F.col("hierarchy") == "법률", 1).when(F.col("hierarchy") == "시행령", 2).otherwise(3)
    return rows.withColumn("rank", rank).join(family, "base")


def resolve_qualifier(word: Column, source: Column, base: Column, act: Column, decree: Column, rule: Column) -> Column:
    """The law that a qualifier names: none or 'this law' the citing one; the family's names or short names its level; null for any other law."""
    w = F.replace(F.coalesce(word, F.lit("")), F.lit(" "), F.lit(""))
    return (
        F.when((w == "") | w.isin(*SELF_WORDS), source)
        .when(w.endswith(F.concat(base, F.lit("시행규칙"))) | w.isin("시행규칙", "규칙"), rule)
        .when(w.endswith(F.concat(base, F.lit("시행령"))) | w.isin("시행령", "영"), decree)
        .when(w.endswith(base) | (w == "법"), act)
    )


def references(articles: DataFrame, families: DataFrame) -> DataFrame:
    """(src_id, src_law, src_article, dst_law, dst_article, basis): distinct targets of each article, basis the first mention.

    articles: (id, law_id, article_no, content); texts are searched where they are read, only what is found is shuffled, so rows may be repeated. Laws outside the family and the article itself are left out; families'
    size is checked by the planner, which broadcasts them only below its own bound.
    """
    rows = articles.select("id", "law_id", "article_no", "content").join(families.select("law_id", "base", "act_id", "decree_id", "rule_id"), "law_id")
    body = F.replace(F.replace(without_heading("content"), F.lit("「"), F.lit("")), F.lit("」"), F.lit(""))
    body = F.replace(F.replace(body, F.concat("base", F.lit(" 시행규칙")), F.concat("base", F.lit("시행규칙"))), F.concat("base", F.lit(" 시행령")), F.concat("base", F.lit("시행령")))
    pattern = F.concat(F.lit("(?U)(?:(?:"), "base", F.lit("시행규칙|"), "base", F.lit(f"시행령|{GENERIC})\\s*)?{ARTICLE}"))
    # What a mention says is taken apart once, inside the array: expressions over a row would be repeated in every branch and filter that uses them.
    part = lambda h, i: F.regexp_extract(h, f"(?U)^([\\s\\S]*){ARTICLE}$", i)
    told = lambda h: F.struct(h.alias("hit"), F.regexp_replace(part(h, 1), "(?U)\\s+$", "").alias("word"), article_code(part(h, 2), part(h, 3)).alias("dst_article"))
    found = rows.withColumn("hits", F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), told))
    each = found.select("id", "law_id", "article_no", "base", "act_id", "decree_id", "rule_id", F.posexplode_outer("hits").alias("place", "m")).where("place is not null")  # a plain posexplode has the planner search each text twice, once for a filter
    target = each.select("id", "law_id", "article_no", "place", "m.hit", "m.dst_article", resolve_qualifier(F.col("m.word"), F.col("law_id"), F.col("base"), F.col("act_id"), F.col("decree_id"), F.col("rule_id")).alias("dst_law"))
    target = target.where(F.col("dst_law").isNotNull() & F.col("dst_article").isNotNull() & ~((F.col("dst_law") == F.col("law_id")) & (F.col("dst_article") == F.col("article_no"))))
    return target.groupBy(F.col("id").alias("src_id"), F.col("law_id").alias("src_law"), F.col("article_no").alias("src_article"), "dst_law", "dst_article").agg(F.trim(F.min_by("hit", "place")).alias("basis"))


def whole_articles(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("is_current") & F.col("paragraph_no").isNull())


def article_nodes(articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Vertices: current whole articles, one a law and article number (the largest id); their texts aren't read."""
    last = whole_articles(articles).groupBy("law_id", "article_no").agg(F.max_by(F.struct("id", "title"), "id").alias("r")).select("law_id", "article_no", "r.*")
    names = laws.groupBy("law_id").agg(F.min("law_name").alias("law_name"), F.min("hierarchy").alias("hierarchy"))
    return last.join(names, "law_id").select(F.col("id").alias("article_pk"), "law_id", "law_name", "hierarchy", "article_no", "title")


def node_references(articles: DataFrame, nodes: DataFrame, families: DataFrame) -> DataFrame:
    """references() of the articles that are vertices."""
    found = references(spread(whole_articles(articles).select("id", "law_id", "article_no", "content")), families)
    return found.join(nodes.select(F.col("article_pk").alias("src_id")), "src_id", "left_semi")


def graph_edges(nodes: DataFrame, refs: DataFrame, families: DataFrame) -> DataFrame:
    """(src, dst, rel, basis, n): references whose target is a vertex. Within a law CITES; between levels DELEGATES from the higher rank down, whichever cites; n counts references folded into one edge, not mentions."""
    at = nodes.select(F.col("law_id").alias("dst_law"), F.col("article_no").alias("dst_article"), F.col("article_pk").alias("dst"))
    rank = families.select("law_id", "rank")
    met = refs.join(at, ["dst_law", "dst_article"])
    met = met.join(rank.withColumnsRenamed({"law_id": "src_law", "rank": "r1"}), "src_law").join(rank.withColumnsRenamed({"law_id": "dst_law", "rank": "r2"}), "dst_law")
    same, down = F.col("src_law") == F.col("dst_law"), F.col("r1") < F.col("r2")
    seq = F.struct("src_law", "src_article", "dst_article", "src_id")
    edges = met.select(
        F.when(same | down, F.col("src_id")).otherwise(F.col("dst")).alias("src"), F.when(same | down, F.col("dst")).otherwise(F.col("src_id")).alias("dst"),
        F.when(same, "CITES").otherwise("DELEGATES").alias("rel"), "basis", seq.alias("seq"),
    )
    return edges.groupBy("src", "dst", "rel").agg(F.min_by("basis", "seq").alias("basis"), F.count(F.lit(1)).alias("n"))


def expand(starts: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One hop out of each start (article_pk), any relation: (article_pk, rel, dst, law_name, article_no, title, basis, n); none for unknown starts."""
    target = nodes.select(F.col("article_pk").alias("dst"), "law_name", "article_no", F.coalesce("title", "law_name").alias("title"))
    hop = edges.join(starts.select(F.col("article_pk").alias("src")).distinct(), "src", "left_semi").join(target, "dst")
    return hop.select(F.col("src").alias("article_pk"), "rel", "dst", "law_name", "article_no", "title", "basis", "n")


def build(articles: DataFrame, laws: DataFrame, stored: tuple[DataFrame, DataFrame] | None = None, keep: bool = False, parts: str = "all") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a rebuild over the stored graph (None: there's none).

    parts: 'all', 'nodes' (edges stay as stored) or 'edges' (nodes stay). keep: what is stored and not built anew survives; without it the
    built parts replace what was stored.
    """
    if parts not in ("all", "nodes", "edges"):
        raise ValueError("parts must be all, nodes or edges")
    families = law_families(laws)
    nodes = article_nodes(articles, laws) if parts != "edges" or stored is None else stored[0]
    edges = graph_edges(nodes, node_references(articles, nodes, families), families)
    if parts == "nodes":
        edges = stored[1] if stored else edges.limit(0)
    if keep and stored:
        merged = lambda new, old, keys: new.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*new.columns))
        nodes = merged(nodes, stored[0], ["article_pk"]) if parts != "edges" else nodes
        edges = merged(edges, stored[1], ["src", "dst", "rel"]) if parts != "nodes" else edges
    return nodes, edges
