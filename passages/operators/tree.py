"""The source tree: paths of ancestor ids joined by dots. Subtree tests look at a node's ancestors, never at pairs of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """The path of every ancestor and of the node itself."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


#: Roots up to which they are looked for inside the row.
FEW_ROOTS = 1000


def expand_subtree(nodes: DataFrame, roots: DataFrame, files_only: bool = True) -> DataFrame:
    """Nodes at or below a root. A choice of a few folders is looked for among a node's own ancestors, without a join or shuffle.

    More roots than FEW_ROOTS are joined on the ancestors' paths; then only paths are shuffled. No nested loop either way. Repeated rows stay.
    """
    rows = nodes.where(F.col("type") != "directory") if files_only else nodes
    chosen = [r["path"] for r in roots.select("path").where("path IS NOT NULL").distinct().limit(FEW_ROOTS + 1).collect()]
    if len(chosen) <= FEW_ROOTS:
        return rows.where(F.arrays_overlap(ancestors(F.col("path")), F.array(*map(F.lit, chosen)).cast("array<string>")))
    met = rows.select("path", F.explode(ancestors(F.col("path"))).alias("_up")).join(roots.select(F.col("path").alias("_up")).distinct(), "_up", "left_semi")
    return rows.join(met.select("path").distinct(), "path", "left_semi")


def tree_listing(nodes: DataFrame, parent: str, directories_only: bool = False) -> DataFrame:
    """Strict descendants of a node with their level and parent, by level and name."""
    rows = nodes.where(F.col("path").startswith(f"{parent}."))
    rows = rows.where(F.col("type") == "directory") if directories_only else rows
    return rows.select("path", "name", "type", F.size(F.split("path", r"\.")).alias("level"), F.regexp_replace("path", r"\.[^.]*$", "").alias("parent_path")).orderBy("level", "name", "path")


def delete_subtree(nodes: DataFrame, children: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of nodes and of a child table with source_path, and one row of how many of each went."""
    gone = (F.col("path") == root) | F.col("path").startswith(f"{root}.")
    removed = nodes.where(gone)
    lost = children.join(removed.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    kept = children.join(removed.select(F.col("path").alias("source_path")), "source_path", "left_anti")
    counts = removed.agg(F.count("*").alias("nodes")).crossJoin(lost.agg(F.count("*").alias("children")))  # two single rows
    return nodes.where(~gone), kept, counts


def tenant_scope(rows: DataFrame, org_id: int, sources: DataFrame | None = None) -> DataFrame:
    """An organisation's rows, and of these the chosen sources' only; no chosen sources, no rows."""
    scoped = rows.where(F.col("org_id") == org_id)
    return scoped if sources is None else scoped.join(sources.select("id").distinct(), "id", "left_semi")


def search_scope(queries: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (query_id, source_id, chunk_id): the chunks of the sources of each query's organisation, for the retrievers' scope.

    queries (query_id, org_id), with one more column source_id where a query names its sources; one without sources sees none.
    """
    named = "source_id" in queries.columns
    owned = sources.select(F.col("id").alias("source_id"), "org_id")
    scope = queries.select("query_id", "org_id", *(["source_id"] if named else [])).join(owned, ["org_id", "source_id"] if named else ["org_id"])
    return scope.join(chunks.select("chunk_id", "source_id"), "source_id").select("query_id", "source_id", "chunk_id").distinct()


#: Roles and their ranks.
ROLES = {"viewer": 1, "editor": 2, "admin": 3, "owner": 4}


def role_rank(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), F.lit(0))


def access_scope(rows: DataFrame, memberships: DataFrame, user_id: int, is_super: bool, min_role: str) -> DataFrame:
    """Rows of the organisations in which the user has at least a role, with that role; a super-admin sees all, as their owner."""
    if is_super:
        return rows.withColumn("role", F.lit("owner"))
    own = memberships.where((F.col("user_id") == user_id) & (role_rank(F.col("role")) >= ROLES.get(min_role, 0)))
    return rows.join(own.groupBy("org_id").agg(F.max_by("role", role_rank(F.col("role"))).alias("role")), "org_id")
