"""Property graph: nodes, edges, set search and bounded paths.

An edge names the person whose chunks are its evidence instead of carrying their ids, so
edges keep a fixed width; ``path_evidence`` resolves the ids by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.corpus import Corpus
from evidex.functions.constants import GRAPH_RELATIONS
from evidex.functions.text import normalize_name, row_id
from evidex.operators.structured import substring_pairs
from evidex.session import cut_lineage

_EDGE = ("edge_id", "src_type", "src", "rel", "dst_type", "dst", "evidence_person")


def make_edges(
    links: DataFrame, src_type: str, rel: str, dst_type: str, src: str, dst: str, owner: str
) -> DataFrame:
    """Edges of one allowed relation from a link table."""
    if (src_type, rel, dst_type) not in GRAPH_RELATIONS:
        raise ValueError(f"Unsupported graph relationship: {src_type}-{rel}-{dst_type}")
    return links.select(
        row_id("edge", F.lit(rel), F.col(src).cast("string"), F.col(dst).cast("string")).alias(
            "edge_id"
        ),
        F.lit(src_type).alias("src_type"),
        F.col(src).cast("string").alias("src"),
        F.lit(rel).alias("rel"),
        F.lit(dst_type).alias("dst_type"),
        F.col(dst).cast("string").alias("dst"),
        F.col(owner).cast("string").alias("evidence_person"),
    )


def second_level(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Owner of an entity's own edges: the last person in id order linked to the entity."""
    owners = members.groupBy(key).agg(F.max("person_id").alias("owner"))
    return links.join(owners, key)


def graph_edges(corpus: Corpus) -> DataFrame:
    """The edge table of the nine relations (G1)."""
    person_links = {
        ("WORKED_AT", "Company", "company_id"): corpus.person_companies,
        ("HAS_SKILL", "Skill", "skill_id"): corpus.person_skills,
        ("USED_TECHNOLOGY", "Technology", "technology_id"): corpus.person_technologies,
        ("WORKED_ON", "Project", "project_id"): corpus.person_projects,
        ("STUDIED_AT", "University", "university_id"): corpus.person_universities,
        ("SPECIALIZES_IN", "Domain", "domain_id"): corpus.person_domains,
    }
    edges = [
        make_edges(links, "Person", rel, kind, "person_id", key, "person_id")
        for (rel, kind, key), links in person_links.items()
    ]
    operates = second_level(corpus.company_domains, corpus.person_companies, "company_id")
    uses = second_level(corpus.project_technologies, corpus.person_projects, "project_id")
    belongs = second_level(corpus.project_domains, corpus.person_projects, "project_id")
    edges += [
        make_edges(operates, "Company", "OPERATES_IN", "Domain", "company_id", "domain_id", "owner"),
        make_edges(uses, "Project", "USES", "Technology", "project_id", "technology_id", "owner"),
        make_edges(belongs, "Project", "BELONGS_TO", "Domain", "project_id", "domain_id", "owner"),
    ]
    return reduce(DataFrame.unionByName, edges)


def graph_nodes(corpus: Corpus, unicode: bool = True) -> DataFrame:
    """The node table: node_id, node_type, name, key."""
    tables = {
        "Company": (corpus.companies, "company_id"),
        "Skill": (corpus.skills, "skill_id"),
        "Technology": (corpus.technologies, "technology_id"),
        "Project": (corpus.projects, "project_id"),
        "University": (corpus.universities, "university_id"),
        "Domain": (corpus.domains, "domain_id"),
    }
    named = [
        df.select(
            F.col(key).alias("node_id"), F.lit(kind).alias("node_type"), "name",
            F.col("normalized_name").alias("key"),
        )
        for kind, (df, key) in tables.items()
    ]
    persons = corpus.people.select(
        F.col("person_id").alias("node_id"),
        F.lit("Person").alias("node_type"),
        F.col("full_name").alias("name"),
        normalize_name(F.col("full_name"), unicode).alias("key"),
    )
    return reduce(DataFrame.unionByName, named, persons)


def replace_edges(stored: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Replace every edge leaving the refreshed source nodes (G2). ``sources``: src."""
    return stored.join(sources.select("src").distinct(), "src", "left_anti").select(
        *_EDGE
    ).unionByName(fresh.select(*_EDGE))


def merge_nodes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes after a sync: fresh names win."""
    return stored.join(fresh.select("node_id"), "node_id", "left_anti").unionByName(
        fresh.dropDuplicates(["node_id"])
    )


def sync_report(people: DataFrame, edges: DataFrame) -> DataFrame:
    """total, synced, failed of a graph build (G11): a person fails when an edge lacks its node."""
    dangling = edges.filter("src is null or dst is null").select(
        F.col("evidence_person").alias("person_id")
    ).distinct()
    marked = people.select("person_id").join(
        dangling.withColumn("bad", F.lit(True)), "person_id", "left"
    )
    return marked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("bad").isNull()).alias("synced"),
        F.count_if("bad").alias("failed"),
    )


_SLOT_TYPE = {"company": "Company", "project": "Project", "domain": "Domain"}


def graph_search(terms: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Persons meeting all companies, projects and domains of a query.

    ``terms``: query_id, slot, term, term_no as of ``query_terms``. A domain is reached
    directly, through a company or through a project. Work starts from the requested nodes,
    so only their neighbourhood is shuffled.
    """
    types = F.create_map(*[F.lit(x) for pair in _SLOT_TYPE.items() for x in pair])
    wanted = terms.filter(F.col("slot").isin(*_SLOT_TYPE)).withColumn(
        "node_type", F.element_at(types, F.col("slot"))
    )
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("n_needed"))
    targets = wanted.join(
        nodes.select("node_type", F.col("key").alias("term"), "node_id"), ["node_type", "term"]
    ).select("query_id", "term_no", F.col("node_id").alias("dst"))
    direct = edges.filter(
        F.col("rel").isin("WORKED_AT", "WORKED_ON", "SPECIALIZES_IN")
    ).select("dst", F.col("src").alias("person_id"))
    onward = edges.filter(F.col("rel").isin("OPERATES_IN", "BELONGS_TO")).select("dst", "src")
    middle = targets.join(onward, "dst").select("query_id", "term_no", F.col("src").alias("dst"))
    reached = targets.unionByName(middle.distinct()).join(direct, "dst")
    return (
        reached.groupBy("query_id", "person_id")
        .agg(F.size(F.collect_set("term_no")).alias("n_met"))
        .join(needed, "query_id")
        .filter("n_met = n_needed")
        .select("query_id", "person_id")
    )


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of every edge with the far node's name: node, nbr, step."""
    both = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")),
                F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")),
            )
        ).alias("way"),
        "edge_id", "rel", "evidence_person",
    ).select("way.node", "way.nbr", "edge_id", "rel", "evidence_person")
    names = nodes.select(F.col("node_id").alias("nbr"), F.coalesce("name", "node_id").alias("name"))
    return both.join(names, "nbr").select(
        "node", "nbr", F.struct("name", "edge_id", "rel", "evidence_person", "nbr").alias("step")
    )


def check_hops(max_hops: int) -> None:
    """Depth validation."""
    if not 1 <= max_hops <= 3:
        raise ValueError("max_hops must be between 1 and 3")


def _order(step: Column) -> Column:
    return F.struct(step["name"], step["edge_id"])


#: Prefixes that end in one node and meet its neighbours in one task, about.
CROWD = 10_000


def meet(prefixes: DataFrame, lists: DataFrame) -> DataFrame:
    """``prefixes`` (person_id, node, ...) joined with the row of their node in ``lists``.

    A node of more than ``CROWD`` prefixes has its list copied to as many parts as it fills.
    """
    crowded = cut_lineage(
        prefixes.groupBy("node").count().filter(F.col("count") > CROWD)
        .select("node", F.ceil(F.col("count") / CROWD).cast("int").alias("parts"))
    )
    parts = F.coalesce(F.col("parts"), F.lit(1))
    dealt = prefixes.join(crowded, "node", "left").withColumn("part", F.pmod(F.xxhash64("person_id"), parts.cast("long")).cast("int"))
    copied = lists.join(crowded, "node", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("parts").join(copied.drop("parts"), ["node", "part"])


def graph_paths(
    subjects: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    max_hops: int = 3,
    limit: int = 100,
) -> DataFrame:
    """The first ``limit`` paths per person, shortest first, then by names and edges.

    Paths follow edges in both directions and use no edge twice. Hubs do not multiply:
    within one order of paths only the first ``limit`` prefixes that can be extended, and
    the first ``limit`` + 3 neighbours of a node, can still contribute, so the caps between
    hops lose nothing. A prefix meets its node's neighbours as one sorted list, and is multiplied
    only as far as its person still needs paths. Prefixes that end in one hub are dealt to several
    tasks. Shorter paths come first, so a person who has ``limit`` of them gets no longer ones.

    ``subjects``: person_id. Result: person_id, position, hops, nodes, relationships,
    edge_ids, evidence_persons, score.
    """
    check_hops(max_hops)
    steps = adjacency(edges, nodes)
    degree = steps.groupBy("node").agg(F.count("*").alias("degree"))
    by_name = Window.partitionBy("node").orderBy(_order(F.col("step")))
    cap = limit + 3

    def first_neighbours(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(by_name)).filter(f"_n <= {cap}").drop("_n")

    # Both neighbour tables are bounded per node and read by every hop, so each is written once.
    ends = cut_lineage(first_neighbours(steps))
    # A neighbour continues a path when it has an edge besides the one leading to it.
    through = cut_lineage(
        first_neighbours(
            steps.join(degree.withColumnRenamed("node", "nbr"), "nbr").filter("degree >= 2")
        )
    )
    per_person = Window.partitionBy("person_id").orderBy("order_key")

    def extend(prefixes: DataFrame, neighbours: DataFrame, own_degree: Column | None = None) -> DataFrame:
        """The first ``limit`` extensions per person; with ``own_degree``, back at the start only if it is 3 or more."""
        lists = neighbours.groupBy("node").agg(F.sort_array(F.collect_list("step")).alias("steps"))
        used = F.transform("path", lambda s: s["edge_id"])

        def fits(step: Column) -> Column:
            fresh = ~F.array_contains(used, step["edge_id"])
            return fresh if own_degree is None else fresh & ((step["nbr"] != F.col("person_id")) | (own_degree >= 3))

        options = F.filter("steps", fits)
        counted = (
            meet(prefixes.withColumn("node", F.element_at("path", -1)["nbr"]), lists)
            .select("person_id", "path", F.slice(options, 1, limit).alias("options"))
            .withColumn("order_key", F.transform("path", _order))
        )
        taken = F.coalesce(F.sum(F.size("options")).over(per_person.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return (
            counted.withColumn("left", (F.lit(limit) - taken).cast("int"))
            .filter(F.col("left") > 0)
            .select("person_id", "path", F.explode(F.slice("options", F.lit(1), F.col("left"))).alias("step"))
            .select("person_id", F.array_append("path", F.col("step")).alias("path"))
        )

    starts = subjects.select("person_id").distinct().withColumn("node", F.col("person_id"))

    def first_steps(neighbours: DataFrame) -> DataFrame:
        rows = starts.join(neighbours, "node").select("person_id", F.array("step").alias("path"))
        ordered = rows.withColumn("order_key", F.transform("path", _order)).withColumn("_n", F.row_number().over(per_person))
        return ordered.filter(f"_n <= {limit}").drop("_n", "order_key")

    levels = [cut_lineage(first_steps(ends))]

    def unfinished(prefixes: DataFrame) -> DataFrame:
        """``prefixes`` of persons who have fewer than ``limit`` paths so far."""
        done = reduce(DataFrame.unionByName, levels).groupBy("person_id").count().filter(F.col("count") >= limit)
        return cut_lineage(prefixes.join(done, "person_id", "left_anti"))

    if max_hops >= 2:
        one = unfinished(first_steps(through))
        levels.append(cut_lineage(extend(one, ends)))
    if max_hops == 3:
        # Back at the start, the node needs an edge besides the two already used.
        own = degree.select(F.col("node").alias("person_id"), F.col("degree").alias("own_degree"))
        two = extend(unfinished(one).join(own, "person_id"), through, F.col("own_degree"))
        levels.append(cut_lineage(extend(cut_lineage(two), ends)))
    return number_paths(reduce(DataFrame.unionByName, levels), nodes, ["person_id"], limit)


def number_paths(paths: DataFrame, nodes: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Final order, cut and columns of collected paths."""
    order = Window.partitionBy(*keys).orderBy("hops", F.transform("path", _order))
    start = nodes.select(F.col("node_id").alias("person_id"), F.col("name").alias("start_name"))
    return (
        paths.withColumn("hops", F.size("path"))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .join(start, "person_id")
        .select(
            *keys,
            "position",
            "hops",
            F.concat(F.array("start_name"), F.transform("path", lambda s: s["name"])).alias("nodes"),
            F.transform("path", lambda s: s["rel"]).alias("relationships"),
            F.transform("path", lambda s: s["edge_id"]).alias("edge_ids"),
            F.array_distinct(F.transform("path", lambda s: s["evidence_person"])).alias(
                "evidence_persons"
            ),
            (F.lit(1.0) / F.size("path")).alias("score"),
        )
    )


def path_evidence(paths: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk ids behind each path, one row each: keys, position, source_no, chunk_id."""
    owners = paths.select(
        *keys, "position", F.posexplode("evidence_persons").alias("source_no", "owner")
    )
    owned = chunks.select(F.col("person_id").alias("owner"), "chunk_id", "ordinal")
    return owners.join(owned, "owner").drop("owner")


def with_evidence(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """Paths whose edges have any evidence."""
    holders = chunks.select(F.col("person_id").alias("holder")).distinct()
    backed = (
        paths.select("edge_ids", F.explode("evidence_persons").alias("holder"))
        .join(holders, "holder", "left_semi")
        .select("edge_ids")
        .distinct()
    )
    return paths.join(backed, "edge_ids", "left_semi")


def explain_paths(paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """One FACT claim per path with evidence."""
    return with_evidence(paths, chunks).withColumns(
        {"claim": F.array_join("nodes", " → "), "kind": F.lit("fact")}
    )


def matching_nodes(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose key contains a term of the query (G9): query_id, node. ``terms``: query_id, term."""
    pairs = substring_pairs(nodes, terms, "key", "term")
    keyed = pairs.join(terms.select("query_id", "term"), "term").select("query_id", "key").distinct()
    return keyed.join(nodes.select("key", F.col("node_id").alias("node")), "key").select(
        "query_id", "node"
    )


def relevant_paths(
    pool: DataFrame,
    terms: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    max_hops: int = 3,
    per_person: int = 2,
) -> DataFrame:
    """Paths of pool members to a requested node, of every length up to ``max_hops``.

    ``pool``: query_id, person_id. ``terms``: query_id, term. Relevance is applied before any
    limit: of each number of hops the first ``per_person`` paths by names and edges are kept, so
    the shortest always are, and longer ones stay as evidence. A path ends at the first requested
    node it meets and uses no edge twice. Ways to the requested nodes grow outward by one hop a
    round; a node keeps ``per_person`` + 3 of them, since at most the edges of a path's own start
    can rule some out, so the caps lose none of the paths kept.
    """
    check_hops(max_hops)
    pair = ["query_id", "person_id"]
    steps = adjacency(edges, nodes)
    marked = cut_lineage(matching_nodes(terms, nodes))
    open_pairs = pool.select(*pair).distinct()
    named = open_pairs.join(marked.withColumnRenamed("node", "person_id"), pair, "left_semi")
    own = steps.withColumnRenamed("node", "person_id")
    # A person whose own name matches has any edge as a relevant path.
    first_edges = named.join(own, "person_id").select(*pair, F.array("step").alias("path"))
    found = [_first(first_edges, pair, "path", per_person)]
    rest = cut_lineage(open_pairs.join(named, pair, "left_anti"))
    still = rest.select("query_id").distinct()

    def unused(path: str) -> Column:
        ids = F.transform(path, lambda s: s["edge_id"])
        return F.size(F.array_distinct(ids)) == F.size(ids)

    # Ways from a node to the nearest requested node, grown by one hop per round.
    ways = marked.select("query_id", "node", F.array().cast(_steps_type(steps)).alias("tail"))
    for hop in range(1, max_hops + 1):
        ways_to = ways.withColumnRenamed("node", "nbr")
        reached = (
            rest.join(own, "person_id")
            .join(ways_to, ["query_id", "nbr"])
            .select(*pair, F.concat(F.array("step"), "tail").alias("path"))
            .filter(unused("path"))
        )
        found.append(cut_lineage(_first(reached, pair, "path", per_person)))
        if hop == max_hops:
            break
        grown = (
            ways_to.join(still, "query_id", "left_semi")
            .join(steps, "nbr")
            .join(marked, ["query_id", "node"], "left_anti")
            .select("query_id", "node", F.concat(F.array("step"), "tail").alias("tail"))
            .filter(unused("tail"))
        )
        ways = cut_lineage(_first(grown, ["query_id", "node"], "tail", per_person + 3))
    paths = reduce(DataFrame.unionByName, found)
    return number_paths(paths, nodes, pair, per_person * max_hops)


def _steps_type(steps: DataFrame) -> str:
    return f"array<{steps.schema['step'].dataType.simpleString()}>"


def _first(df: DataFrame, keys: list[str], path: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.transform(path, _order))
    return df.withColumn("_n", F.row_number().over(order)).filter(f"_n <= {n}").drop("_n")
