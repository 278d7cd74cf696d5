"""The queries over listings, names and events, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import paths as P
from trellis.functions import reports as R
from trellis.operators import audit, nodes, planner, state
from trellis.plans.fixtures import SNAPSHOTS, snapshots, sql_text
from trellis.sources.tables import table
from trellis.streaming.changes import telling

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Files as a listing gives them; the text runs in both engines.
_FILES = """select cast(p_partkey as varchar(20)) as file_id, concat('d', cast(p_partkey % 11 as varchar(20))) as parent_id,
  case p_partkey % 9 when 0 then 'a.tmp' when 1 then '.trellis.tmp.7' when 2 then '..' when 3 then '~$draft' when 4 then 'token.json' when 5 then 'client_secret_1.json' when 6 then 'state.db-wal' else p_name end as name,
  case p_partkey % 4 when 0 then 'application/vnd.google-apps.folder' when 1 then 'application/vnd.google-apps.document' else 'text/plain' end as mime_type,
  case when p_partkey % 5 > 0 then md5(p_name) end as md5, case when p_partkey % 6 > 0 then p_size end as size, p_partkey % 7 = 0 as trashed,
  case p_partkey % 3 when 0 then concat('2024-02-0', cast(1 + p_size % 9 as varchar(20)), 'T10:20:30.5Z') when 1 then concat('2024-02-0', cast(1 + p_size % 9 as varchar(20)), 'T10:20:30+02:00') else 'yesterday' end as modified
  from {part}"""
_LISTED = _FILES.replace("{part}", "part")


def _files(spark, d):
    return spark.sql(_FILES, part=table(spark, d, "part"))


@query(f"with f as ({_LISTED}) select file_id, name, mime_type from f where parent_id = 'd3' and not trashed")
def children_listing(spark, d):
    return nodes.children(_files(spark, d), "d3", "file_id", "name", "mime_type")


@query(f"""with f as ({_LISTED}) select file_id, case when trashed then 'trashed' when mime_type = 'application/vnd.google-apps.document' then 'native'
  when name like '%.tmp' or name like '~$%' or starts_with(name, '.trellis.tmp.') then 'ignored' when name in ('', '.', '..') then 'invalid' else 'ok' end as rule from f""")
def listing_rules(spark, d):
    return nodes.child_rules(_files(spark, d), ["*.tmp", "~$*"]).select("file_id", "rule")


@query(f"""with f as ({_LISTED}) select file_id, parent_id, name, mime_type, coalesce(md5, '') as md5, cast(coalesce(size, 0) as bigint) as size, trashed,
  case when modified = 'yesterday' then 0 when modified like '%Z' then epoch_us(cast(replace(replace(modified, 'T', ' '), 'Z', '') as timestamp)) * 1000
    else (epoch_us(cast(replace(left(modified, 19), 'T', ' ') as timestamp)) - 7200000000) * 1000 end as modified_ns from f""")
def mirror_rows(spark, d):
    return nodes.from_feed(_files(spark, d))


@query(f"with f as ({_LISTED}) select file_id, name in ('token.json', 'credentials.json') or name like 'client_secret_%.json' or regexp_matches(name, '[.](db|db-wal|db-shm)$') as sensitive from f")
def sensitive_names(spark, d):
    return _files(spark, d).select("file_id", audit.sensitive_name(F.col("name")).alias("sensitive"))


@query(f"with f as ({_LISTED}) select * exclude (md5, size, modified, trashed) from f where file_id in (select cast(c_custkey as varchar) from customer where c_nationkey = 7)")
def nodes_found(spark, d):
    keys = table(spark, d, "customer").where("c_nationkey = 7").select(F.col("c_custkey").cast("string").alias("file_id"))
    return nodes.found(_files(spark, d), keys, "file_id").drop("md5", "size", "modified", "trashed")


@query(sql_text(f"with {SNAPSHOTS} select row_number() over (order by rel_path) as ord, rel_path, file_id from base"))
def baseline_ordered(spark, d):
    return planner.numbered(snapshots(spark, d)[0].select("rel_path", "file_id"), [F.col("rel_path")]).select("ord", "rel_path", "file_id")


@query(sql_text(f"with {SNAPSHOTS} select row_number() over (order by length(rel_path) - length(replace(rel_path, '/', '')) desc, rel_path desc) as ord, rel_path from loc"))
def removal_order(spark, d):
    local = snapshots(spark, d)[1].select("rel_path")
    return planner.numbered(local, [P.depth(F.col("rel_path")).desc(), F.col("rel_path").desc()]).select("ord", "rel_path")


@query("""select c_custkey, concat(case when c_custkey % 5 = 0 then '' else case c_custkey % 5 when 1 then 'errors' when 2 then 'local→drive' when 3 then 'drive→local' else 'conflict' end end,
  case when c_custkey % 5 > 0 and c_custkey % 3 > 0 then ' + ' else '' end, case when c_custkey % 3 > 0 then concat('“', c_mktsegment, '”') else '' end) as label from customer""")
def filter_labels(spark, d):
    k = F.col("c_custkey")
    side = F.element_at(F.array(*map(F.lit, ("", "error", "local", "remote", "conflict"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", R.filter_label(side, F.when(k % 3 > 0, F.col("c_mktsegment")).otherwise("")).alias("label"))


@query("select event_id, event_type = 'error' and event_id % 2 = 0 as expired from events")
def expired_grants(spark, d):
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('oauth2: "invalid_grant" '), "props")).otherwise(F.col("props")))
    return table(spark, d, "events").select("event_id", R.expired_grant(error).alias("expired"))


@query("""select event_id from events where event_type <> 'view' and event_id % 4 <> 1 and (event_id % 4 <> 3 or event_id % 8 = 3)""")
def events_that_tell(spark, d):
    k = F.col("event_id")
    path = F.when(k % 4 == 0, "/r").when(k % 4 == 1, F.concat(F.lit("/r/x.tmp/"), k.cast("string"))).when(k % 8 == 7, F.lit("/q/y.tmp")).when(k % 4 == 3, F.lit("/q/x.tmp/y")).otherwise("/r/d/e")
    op = F.when(F.col("event_type") == "view", "chmod").otherwise("write")
    return telling(table(spark, d, "events").select("event_id", path.alias("path"), op.alias("op")), "/r", ["*.tmp"]).select("event_id")


@query("""with recursive w(failures, wait) as (select 1, 45 union all select failures + 1, case when wait < 450 then wait * 2 else wait end from w where failures < 12)
select cast(failures as bigint) as failures, cast(wait as bigint) as wait from w""")
def backoff_waits(spark, d):
    return spark.createDataFrame(list(enumerate(state.backoffs(45, 12), 1)), "failures long, wait long")


@query(sql_text(f"""with {SNAPSHOTS}, p as (
  select 1 from base b left join loc l on l.rel_path = b.rel_path where l.rel_path is null or l.md5 <> b.md5
  union all select 1 from base b left join rem r on r.file_id = b.file_id where r.file_id is null or r.md5 <> b.md5
  union all select 1 from loc where rel_path not in (select rel_path from base) union all select 1 from rem where file_id not in (select file_id from base))
select count(*) as problems, count(*) = 0 as healthy from p"""))
def health_verdict(spark, d):
    return audit.health(audit.divergence(*snapshots(spark, d)))
