"""Ancestors in trees of any depth (inventory C17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.staging import staged, unstage


def jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes(id, parent), ids unique: tables of (id, up), up being the node 1, 2, 4, ... levels above, and (id, depth, top, state).

    Each round doubles the reach by one join, so there are some log2(depth) of them, and it ends when no node reaches further. A node on a cycle, or
    below one, reaches on for ever: whoever still does so beyond the number of nodes is one, and has no depth. A parent that isn't a node ends the way: the top is
    told to be an orphan, and so are those below it.
    """
    c = F.col
    known = nodes.select(c("id").alias("parent"), c("id").alias("up"))
    now = staged(nodes.join(known, "parent", "left").select("id", "up", c("up").isNotNull().cast("long").alias("depth"), F.coalesce("up", "id").alias("top"), (c("parent").isNotNull() & c("up").isNull()).alias("orphan")))
    n, reach, held = now.count(), 1, []
    while True:
        held.append(now)
        if not now.filter("up is not null").limit(1).count() or reach > n:
            break
        far = now.select(c("id").alias("up"), c("up").alias("_up"), c("depth").alias("_depth"), c("top").alias("_top"))
        met = now.join(far, "up", "left")
        now = staged(met.select("id", c("_up").alias("up"), (c("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_top", "top").alias("top"), "orphan"))
        reach *= 2
    lost = held[0].filter("orphan").select(c("id").alias("top"), F.lit("orphan").alias("_state"))
    ends = now.join(lost, "top", "left")
    state = F.when(c("up").isNotNull(), "cycle").otherwise(F.coalesce("_state", F.lit("rooted")))
    on_cycle = c("up").isNotNull()
    told = ends.select("id", F.when(~on_cycle, c("depth")).alias("depth"), F.when(~on_cycle, c("top")).alias("top"), state.alias("state"))
    return held, told


def ancestors(nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, distance and ancestor of each asked node (all, if none are asked), and of each of its ancestors; nodes of a cycle have none.

    From the longest jump down to the shortest, all that is known of a node's way is joined to the jump, so a way of d nodes takes log2(d) joins and d rows.
    """
    c = F.col
    held, told = jumps(nodes)
    ways = told.filter("state <> 'cycle'").select("id")
    ways = ways if asked is None else ways.join(asked.select("id").distinct(), "id")
    ways = ways.select("id", F.lit(0).cast("long").alias("distance"), c("id").alias("ancestor"))
    for k in range(len(held) - 1, -1, -1):
        up = held[k].filter("up is not null").select(c("id").alias("ancestor"), "up")
        more = ways.join(up, "ancestor").select("id", (c("distance") + 2**k).alias("distance"), c("up").alias("ancestor"))
        ways = staged(ways.unionByName(more))
    unstage(*held[1:])
    return ways.filter("distance > 0")


def company_tree(t) -> DataFrame:
    """Companies four to a parent, but for some: number 10 and 11 are each other's parent, and those that end in 77 have a parent that isn't there."""
    c = F.col("company_id")
    parent = F.when(c == 10, 11).when(c == 11, 10).when(c % 100 == 77, -c).when(c > 0, F.floor((c - 1) / 4))
    return t.company.select(c.alias("id"), parent.cast("long").alias("parent"))


TREE = "n AS (SELECT company_id AS id, CASE WHEN company_id = 10 THEN 11 WHEN company_id = 11 THEN 10 WHEN company_id % 100 = 77 THEN -company_id WHEN company_id > 0 THEN (company_id - 1) // 4 END AS parent FROM company)"


@query("c17_ancestors_of_nodes", "WITH RECURSIVE n AS (SELECT company_id AS id, CASE WHEN company_id > 0 THEN (company_id - 1) // 4 END AS parent FROM company), up AS (SELECT id, parent AS anc, 1 AS depth FROM n WHERE parent IS NOT NULL UNION ALL SELECT up.id, n.parent, depth + 1 FROM up JOIN n ON n.id = up.anc WHERE n.parent IS NOT NULL) SELECT n.id, coalesce(string_agg(anc::VARCHAR, '>' ORDER BY depth DESC), '') AS ancestors FROM n LEFT JOIN up USING (id) GROUP BY 1")
def c17(t):
    """All ancestors of each node, the root first."""
    c = F.col
    nodes = t.company.select(c("company_id").alias("id"), F.when(c("company_id") > 0, F.floor((c("company_id") - 1) / 4)).cast("long").alias("parent"))
    way = F.array_sort(F.collect_list(F.struct((-c("distance")).alias("k"), "ancestor")))
    found = ancestors(nodes).groupBy("id").agg(F.concat_ws(">", F.transform(way, lambda x: x["ancestor"].cast("string"))).alias("ancestors"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("ancestors", F.lit("")).alias("ancestors"))


@query("c17_states_of_nodes", f"""WITH RECURSIVE {TREE}, up AS (SELECT id, id AS anc, 0 AS depth FROM n UNION ALL SELECT up.id, p.id, depth + 1 FROM up JOIN n ON n.id = up.anc JOIN n p ON p.id = n.parent WHERE depth <= (SELECT count(*) FROM n)),
  e AS (SELECT id, max(depth) AS depth, arg_max(anc, depth) AS top FROM up GROUP BY 1)
  SELECT e.id, CASE WHEN depth <= (SELECT count(*) FROM n) THEN depth END AS depth, CASE WHEN depth <= (SELECT count(*) FROM n) THEN top END AS top, CASE WHEN depth > (SELECT count(*) FROM n) THEN 'cycle' WHEN n.parent IS NOT NULL THEN 'orphan' ELSE 'rooted' END AS state FROM e JOIN n ON n.id = e.top""")
def c17_states(t):
    """How deep each node is, below what, and whether its way ends at a root, at a missing parent or never."""
    return jumps(company_tree(t))[1]
