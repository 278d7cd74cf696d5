"""Snapshots, trees and logs derived from the tables, by integer residues only; the texts run in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.sources.tables import table

SNAPSHOTS = """
src as (
  select o_orderkey as k,
         concat('d', cast(o_custkey % 50 as varchar(20)), '/e', cast(o_orderkey % 7 as varchar(20)), '/o', cast(o_orderkey as varchar(20)), '.txt') as p,
         md5(concat({content})) as h, cast(length(o_orderpriority) + {size} as bigint) as sz
  from {orders}),
base as (
  select concat('id', cast(k as varchar(20))) as file_id, p as rel_path, h as md5, h as drive_md5, sz as size, cast(1 as bigint) as version
  from src where k % 20 <> 19 and k % 23 <> 22),
loc as (
  select case when k % 13 = 0 then concat('moved/', p) else p end as rel_path,
         case when k % 7 = 0 then md5(concat(h, case when k % 2 = 0 then 'B' else 'L' end)) else h end as md5, sz as size
  from src where k % 11 <> 0 and k % 20 <> 18),
rem as (
  select case when k % 23 = 22 then concat('new', cast(k as varchar(20))) else concat('id', cast(k as varchar(20))) end as file_id,
         case when k % 17 = 0 then concat('rmoved/', p) else p end as rel_path,
         case when k % 5 = 0 then md5(concat(h, case when k % 2 = 0 then 'B' else 'R' end)) else h end as md5,
         sz as size, cast(case when k % 9 = 0 then 2 else 1 end as bigint) as version
  from src where k % 19 <> 0)"""
#: Contents that differ by order, and contents that many orders share.
FINE = {"content": "cast(o_orderkey as varchar(20)), '|', o_orderstatus, '|', o_orderpriority", "size": "o_orderkey % 97"}
COARSE = {"content": "o_orderstatus, '|', o_orderpriority", "size": "0"}

NODES = """
nodes as (
  select concat('r', cast(r_regionkey as varchar(20))) as file_id, 'root' as parent_id, r_name as name from {region}
  union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))), n_name from {nation}
  union all select concat('c', cast(c_custkey as varchar(20))), case when c_custkey % 31 = 0 then concat('gone', cast(c_custkey % 3 as varchar(20))) else concat('n', cast(c_nationkey as varchar(20))) end,
                   case when c_custkey % 4 = 0 then concat('Cust', cast(c_custkey % 60 as varchar(20))) when c_custkey % 4 = 1 then concat('cust', cast(c_custkey % 60 as varchar(20))) else c_name end from {customer}
  union all select 'x1', 'x2', 'loop' union all select 'x2', 'x1', 'pool')"""

#: An instant for the names of conflicts.
NOW = "timestamp '2026-07-08 10:30:00'"


def sql_text(text: str, of: dict[str, str] | None = None) -> str:
    """The text for an engine in which the tables have their own names."""
    for name, value in {**FINE, **(of or {}), **{t: t for t in ("orders", "region", "nation", "customer")}}.items():
        text = text.replace("{" + name + "}", value)
    return text


def snapshots(spark: SparkSession, sf_dir: str, of: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = SNAPSHOTS
    for name, value in (of or FINE).items():
        text = text.replace("{" + name + "}", value)
    orders = table(spark, sf_dir, "orders")
    base, local, remote = (spark.sql(f"with {text} select * from {name}", orders=orders) for name in ("base", "loc", "rem"))
    return base, local, remote


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"with {NODES} select * from nodes", **{t: table(spark, sf_dir, t) for t in ("region", "nation", "customer")})
