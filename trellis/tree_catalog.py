"""The queries over trees of files and directories, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import planner
from trellis.plans.fixtures import NOW
from trellis.plans.trees import COLLAPSED, ORDERED, tree_sql, trees


def _tree(spark: SparkSession, sf_dir: str) -> planner.Tree:
    t = trees(spark, sf_dir)
    return planner.Tree(t["base"], t["loc"], t["rem"], "test_box", F.expr(NOW), t["shad"], t["unread"], case_fold=True, prefer_newer=True)


def tree_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.numbered(planner.planned_tree(_tree(spark, sf_dir))[0], planner.run_order())


def tree_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.planned_tree(_tree(spark, sf_dir))[1]


def tree_dir_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    by_remote = planner.remote_dir_moves(tree.base, tree.remote)
    found = planner.local_dir_moves(tree, by_remote).select(F.lit("local").alias("side"), "from", "to")
    return found.union(by_remote.select(F.lit("remote"), "from", "to"))


def tree_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    plan = planner.collapsed_tree(planner.planned_tree(tree)[0], tree.remote)[0]
    return plan.select("stage", "type", "rel_path", "is_dir", "subtree_files", "entries")


def tree_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = _tree(spark, sf_dir)
    tracked = tree.base.where("not is_dir").count()
    plan = planner.collapsed_tree(planner.planned_tree(tree)[0], tree.remote)[0]
    return planner.guarded(plan, tracked, 0.02, confirmed=False, bin_available=False).withColumn("tracked", F.lit(tracked).cast("long"))


def tree_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of the plan with one of its own rows put in again, and a file beneath one of its files."""
    plan = planner.planned_tree(_tree(spark, sf_dir))[0]
    again = plan.where("type = 'update_remote' and rel_path like '%7.txt'")
    return planner.overlaps_tree(plan.union(again).union(again.withColumn("rel_path", F.concat("rel_path", F.lit("/x")))))


def held_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trees(spark, sf_dir)
    return planner.expanded(t["base"], spark.createDataFrame([("d2",), ("d4/e1",), ("d6/none",)], "rel_path string"))


QUERIES = {f.__name__: f for f in (tree_plan, tree_skips, tree_dir_moves, tree_collapse, tree_guard, tree_overlaps, held_ids)}
SQL = {
    "tree_plan": tree_sql(ORDERED),
    "tree_skips": tree_sql("select * from skips"),
    "tree_dir_moves": tree_sql("""select 'local' as side, f as "from", t as "to" from ld union all select 'remote', f, t from rd"""),
    "tree_collapse": tree_sql(COLLAPSED),
    "tree_guard": tree_sql(
        ", n as (select cast(count(*) filter (where type = 'quarantine_local' and not is_dir) as bigint) as deletions from final), t as (select cast(count(*) as bigint) as tracked from base where not is_dir) "
        "select deletions, deletions > 10 and deletions * 50 > tracked as tripped, tracked from n, t"
    ),
    "tree_overlaps": tree_sql(
        ", p as (select rel_path, is_dir from final where stage = 6 union all select rel_path, false from final where type = 'update_remote' and rel_path like '%7.txt' union all select concat(rel_path, '/x'), false from final where type = 'update_remote' and rel_path like '%7.txt') "
        "select rel_path, 'twice' as problem from p group by rel_path having count(*) > 1 union all select distinct a.rel_path, 'beneath' from p a join p b on starts_with(a.rel_path, concat(b.rel_path, '/')) where not a.is_dir and not b.is_dir"
    ),
    "held_ids": tree_sql("select file_id from base where rel_path in ('d2', 'd4/e1') or starts_with(rel_path, 'd2/') or starts_with(rel_path, 'd4/e1/')"),
}
