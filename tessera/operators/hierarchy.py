"""Parent-child links to full hierarchies: paths, depths, roots, descendants and circles.

Method: frontier joins, level by level, start at the roots and extend path and depth of each node until no node is left below the frontier.
Nodes that no frontier reaches lie on a circle or lead into one: pointer doubling over those few finds the circles, and frontiers that start there
reach what leads in. Ancestor pairs yield the descendants: the pairs at the largest distance so far are joined with all pairs, so each pair is made once and
the rounds are the logarithm of the depth.

Every level is written to the shared folder, so a step's plan is short and a lost executor costs one step. A frontier that is small by its file size
is broadcast by the planner; a large one is sort-merged, and AQE splits the task of a parent with very many children (the parent side has one row
per key). When half of the links that a step reads are behind the frontier they are left out of the next ones, so all steps together read the links about
twice. Chains deeper than PATIENCE levels are rare and thin, so a step per level would cost more than its rows: from there on a hop may bridge several
levels (the links joined with themselves, as long as they stay under ROWS or the number of links), and a frontier join extends paths and depths
by all of them at once.

Defined cases: rows with a null id are left out. Rows repeated under one id count once, with the smallest non-null
parent and name. A null, blank or unknown parent makes a root. A node that is its own parent is a circle of one.
An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.runtime import Scratch, is_blank

#: Levels joined one by one before hops may bridge several; steps between two widenings; rows that the widened hops may have at least.
PATIENCE, STEPS, ROWS = 64, 8, 1 << 23


def parent_links(nodes: DataFrame, id_col: str = "id", parent_col: str = "container_id", name_col: str = "name") -> DataFrame:
    """(id, parent, name): one row per id, parent null where it has none among the ids."""
    one = (
        nodes.select(F.col(id_col).alias("id"), F.when(~is_blank(parent_col), F.col(parent_col)).alias("parent"), F.col(name_col).alias("name"))
        .filter("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"), F.min("name").alias("name"))
    )
    ids = nodes.select(F.col(id_col).alias("pid")).filter("pid IS NOT NULL").distinct()
    return one.join(ids, one.parent == ids.pid, "left").select("id", F.col("pid").alias("parent"), "name")


def _hops(links: DataFrame, paths: bool) -> DataFrame:
    """(top, id, parent, dist and, with paths, names): top is `dist` levels above id, names are those below top down to id."""
    return links.filter("parent IS NOT NULL").select(F.col("parent").alias("top"), "id", "parent", F.lit(1).alias("dist"), *([F.coalesce("name", F.lit("?")).alias("names")] if paths else []))


def _widened(hops: DataFrame, reach: int, paths: bool) -> DataFrame:
    """Hops of up to twice the reach: the longest ones joined with all that begin where they end."""
    long = hops.filter(F.col("dist") == reach).select("top", F.col("id").alias("mid"), *([F.col("names").alias("upper")] if paths else []))
    far = long.join(hops.withColumnRenamed("top", "mid"), "mid").select("top", "id", "parent", (F.col("dist") + reach).alias("dist"), *([F.concat_ws(".", "upper", "names").alias("names")] if paths else []))
    return hops.unionByName(far)


def _grow(scratch: Scratch, links: DataFrame, frontier: DataFrame, label: str, left: int, paths: bool, step: int, patience: int, rows: int) -> tuple[DataFrame | None, int]:
    """(all that hangs below `frontier`, how many of the `left` links no frontier reached).

    frontier: id, root_id, depth and, with paths, path and n_above. The result also has parent.
    """
    hops, reach, steps, k, held, since, room = _hops(links, paths), 1, 0, 0, left, [], max(left, rows)
    extra = ["path", "n_above"] if paths else []
    while left:
        up = frontier.select(F.col("id").alias("top"), "root_id", "depth", *extra)
        down = hops.join(up, "top").select(
            "id", "parent", "root_id", (F.col("depth") + F.col("dist") * step).cast("int").alias("depth"), (F.col("dist") == reach).alias("edge"),
            *([F.concat_ws(".", "path", "names").alias("path"), (F.col("n_above") + F.col("dist")).cast("int").alias("n_above")] if paths else []),
        )
        seen = Observation()
        found = scratch.cut(down.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("edge").alias("edge")), f"{label}/{k:06d}")
        got, k, steps = seen.get, k + 1, steps + 1
        left -= got["n"]
        if not got["edge"]:
            break
        frontier = found.filter("edge")
        since.append(found)
        widen = k >= patience and (reach == 1 or steps >= STEPS) and 2 * reach * left * (max(1, reach // 8) if paths else 1) <= room
        if left and (left * 2 <= held or widen):
            behind = scratch.several([f"{label}/{i:06d}" for i in range(k - len(since), k)], found.schema).select("id")
            hops, held, since = hops.join(behind, "id", "left_anti"), left, []
            if widen:
                hops, reach, steps = _widened(hops, reach, paths), reach * 2, 0
            hops = scratch.cut(hops, f"{label}-hops/{k:06d}")
    return (scratch.several([f"{label}/{i:06d}" for i in range(k)], found.schema).drop("edge") if k else None), left


def _circles(scratch: Scratch, rest: DataFrame) -> DataFrame:
    """(id, parent, root_id) of the nodes on circles; `rest` (id, parent) holds circles and what leads into them, so each parent is in it."""
    now = scratch.cut(rest.select("id", "parent", F.col("parent").alias("jump"), F.least("id", "parent").alias("low")), "jump0")
    k, before = 0, None
    while True:
        stat = now.agg(F.count_distinct("jump").alias("images"), F.sum(F.xxhash64("low").cast("decimal(38,0)")).alias("lows")).first()
        if (stat.images, stat.lows) == before:
            break  # with steady images and minima every jump ends on a circle and every low covers it
        before, k = (stat.images, stat.lows), k + 1
        over = now.select(F.col("id").alias("jump"), F.col("jump").alias("j2"), F.col("low").alias("l2"))
        now = scratch.cut(now.join(over, "jump").select("id", "parent", F.col("j2").alias("jump"), F.least("low", "l2").alias("low")), f"jump{k}")
        scratch.drop(f"jump{k - 1}")
    on = now.select(F.col("jump").alias("id")).distinct()
    return now.join(on, "id", "left_semi").select("id", "parent", F.col("low").alias("root_id"))


def hierarchy(nodes: DataFrame, id_col: str = "id", parent_col: str = "container_id", name_col: str = "name", paths: bool = True, patience: int = PATIENCE, rows: int = ROWS) -> DataFrame:
    """One row per id: id, parent, root_id, depth and, with paths, path (names joined by a full stop) and n_above (how many names are before its own).

    depth is the number of steps to the root; -1 on a circle, -2 where the id leads into one; root_id is then the
    smallest id on the circle. The path of an id that leads into a circle begins at the circle, that of one on a circle is its name.
    """
    scratch = Scratch(nodes.sparkSession, "tree")
    seen = Observation()
    links = scratch.cut(parent_links(nodes, id_col, parent_col, name_col).observe(seen, F.count("parent").alias("n")), "links")
    name = F.coalesce("name", F.lit("?")).alias("path")
    first = lambda df, depth: df.select("id", "parent", "root_id", F.lit(depth).cast("int").alias("depth"), *([name, F.lit(0).alias("n_above")] if paths else []))
    roots = first(links.filter("parent IS NULL").withColumn("root_id", F.col("id")), 0)
    below, left = _grow(scratch, links, roots, "level", seen.get["n"], paths, 1, patience, rows)
    out = roots if below is None else roots.unionByName(below)
    if not left:
        return out
    rest = links.filter("parent IS NOT NULL")
    rest = scratch.cut(rest if below is None else rest.join(below.select("id"), "id", "left_anti"), "rest")
    seen = Observation()
    on = _circles(scratch, rest)
    on = scratch.cut((on.join(rest.select("id", "name"), "id") if paths else on).observe(seen, F.count(F.lit(1)).alias("n")), "circles")
    rings, entry = first(on, -1), first(on, -2)
    tails, _ = _grow(scratch, rest.join(on.select("id"), "id", "left_anti"), entry, "tail", left - seen.get["n"], paths, 0, patience, rows)
    out = out.unionByName(rings)
    return out if tails is None else out.unionByName(tails)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) of the rows of `hierarchy`: every id with all ids inside it.

    What leads into a circle is below the circle's id where it enters; ids on a circle have no ancestors.
    """
    scratch = Scratch(tree.sparkSession, "descendants")
    links = tree.filter("parent IS NOT NULL AND depth <> -1").select(F.col("parent").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(1).alias("distance"))
    every, n = scratch.counted(links, "pairs/00")
    reach, k = 1, 0
    while n:
        long = every.filter(F.col("distance") == reach).select("ancestor_id", F.col("descendant_id").alias("mid"))  # one row per mid
        far = long.join(every.withColumnRenamed("ancestor_id", "mid"), "mid").select("ancestor_id", "descendant_id", (F.col("distance") + reach).alias("distance"))
        k += 1
        _, n = scratch.counted(far, f"pairs/{k:02d}")
        every, reach = scratch.several([f"pairs/{i:02d}" for i in range(k + 1)], links.schema), 2 * reach
    return every


def circles(tree: DataFrame) -> DataFrame:
    """One row per circle: its smallest id, how many ids lie on it and how many lead into it."""
    bad = tree.filter("depth < 0")
    return bad.groupBy("root_id").agg(F.count_if(F.col("depth") == -1).alias("on_circle"), F.count_if(F.col("depth") == -2).alias("leading_in"))
