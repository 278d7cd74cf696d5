"""The queries over feeds, timers, trees of digests and committed plans, with the SQL that they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from trellis.functions import reports as R
from trellis.operators import audit, commit, digests, planner, status, watching
from trellis.operators import feed as feed_ops
from trellis.operators import nodes as trees_of
from trellis.operators.nodes import tree_paths
from trellis.plans.fixtures import NODES, NOW, nodes, sql_text
from trellis.plans.trees import COLLAPSED, ORDERED, TREES, moved_sql, tree_sql, trees
from trellis.sources.change_feed import feed, hold, publish, release
from trellis.sources.clustered import clustered
from trellis.sources.json_view import write_view
from trellis.sources.store import Store
from trellis.sources.tables import shared, staged, table
from trellis.streaming.changes import debounced, merge_stream

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""with s as (select c_custkey as user_id, c_mktsegment as event_type from customer), l as (select user_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) t where k = 1)
select * from s where user_id not in (select user_id from l) union all select * from l where event_type <> 'error'""")
def feed_mirror(spark, d):
    """Events as a log with tokens, merged by a stream into the keyed table of customers; half of it is withheld at first."""
    here = f"{shared(spark)}/trellis/feed-{uuid.uuid4().hex}"
    store, log, offsets = Store(spark, f"{here}/mirror"), f"{here}/log", f"{here}/offsets"
    changes = table(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type", (F.col("event_type") == "error").alias("removed"))
    store.keyed("rows", table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type")), "user_id", 16)
    first, last = changes.agg(F.min("seq"), F.max("seq")).first()
    middle = (first + last) // 2 if first is not None else 0
    for part in (changes.where(F.col("seq") <= middle), changes.where(F.col("seq") > middle)):
        publish(part, log)
        hold(log)
        merge_stream(feed(spark, log, changes.schema), store.folder, offsets, "user_id", "seq", "removed").awaitTermination()
        release(log)
    merge_stream(feed(spark, log, changes.schema), store.folder, offsets, "user_id", "seq", "removed").awaitTermination()
    return store.table("rows")


_SINCE = "select user_id, event_id, {columns} from (select *, cast(sum(cast(c as int)) over (partition by user_id, g order by event_id) as bigint) as n from (select *, sum(cast(r as int)) over (partition by user_id order by event_id) as g from (select user_id, event_id, {counted} as c, {reset} as r from events) a) b) d"


@query(_SINCE.format(columns="n as pending", counted="event_type in ('click', 'view')", reset="event_type = 'purchase'"))
def pending_changes(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return watching.since(events, "user_id", "event_id", F.col("event_type").isin("click", "view"), F.col("event_type") == "purchase", "pending").drop("event_type")


@query(_SINCE.format(columns="n as failures, n >= 3 as latched", counted="event_type in ('error', 'signup')", reset="event_type not in ('error', 'signup')"))
def failure_latch(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return watching.latched(events, "user_id", "event_id", F.col("event_type").isin("error", "signup")).drop("event_type")


@query("""with b as (select distinct user_id, epoch_us(ts) as t0 from events), l as (select user_id, t0, lead(t0) over (partition by user_id order by t0) as later, (select max(epoch_us(ts)) from events) as limit_at from b)
select user_id, t0 as last_us, later as back_us from l where coalesce(later, limit_at) - t0 > 172800000000""")
def silent_users(spark, d):
    events = table(spark, d, "events")
    until = events.agg(F.max("ts")).first()[0]
    found = watching.silences(events, "user_id", "ts", 172_800_000_000, F.lit(until))
    return found.select("user_id", F.unix_micros("last").alias("last_us"), F.unix_micros("back").alias("back_us"))


@query(sql_text(f"""with recursive {NODES}, t as (
  select file_id, name as rel_path, 1 as depth from nodes where parent_id = 'r2'
  union all select n.file_id, concat(t.rel_path, '/', n.name), t.depth + 1 from t join nodes n on n.parent_id = t.file_id)
select * from t"""))
def subtree_paths(spark, d):
    """The walk of one directory: its id is the root."""
    return tree_paths(nodes(spark, d), "r2")


@query(f"""with {TREES.replace('{orders}', 'orders')}, x as (select rel_path, is_dir, md5 from loc), y as (select rel_path, is_dir, md5 from rem),
j as (select coalesce(x.rel_path, y.rel_path) as rel_path, x.is_dir as a, y.is_dir as b, x.md5 as ma, y.md5 as mb from x full join y on x.rel_path = y.rel_path)
select rel_path, case when b is null then 'only_a' when a is null then 'only_b' when a <> b then 'kind' else 'changed' end as why from j
where (a is null or b is null or a <> b or (not a and ma <> mb))
  and (not contains(rel_path, '/') or regexp_replace(rel_path, '/[^/]*$', '') in (select rel_path from j where a and b))""")
def tree_difference(spark, d):
    """Where the local and the remote tree differ, by digests from the root down."""
    t = trees(spark, d)
    local, remote = (digests.kept_tree(t[side], F.col("md5")) for side in ("loc", "rem"))
    return digests.differences(local, remote)


def _sides(spark, d):
    t = trees(spark, d)
    return commit.Sides(t["base"].select(*commit.BASE), t["loc"].select(*commit.LOCAL), t["rem"].select(*commit.REMOTE)), t


@query(tree_sql(f"""
, w as (select coalesce(file_id, concat(case when type = 'mkdir_remote' then 'mk:' else 'up:' end, rel_path)) as file_id, rel_path, is_dir from final where type in ('upload', 'update_remote', 'download', 'record', 'mkdir_remote', 'mkdir_local')),
m as (select file_id, new_rel_path as rel_path, is_dir from final where type in ('move_local', 'move_remote') and not is_dir and file_id in (select file_id from base) and file_id not in (select file_id from w)),
noted as (select * from w union all select * from m),
stay as (select file_id, coalesce((select x.t from mv x where x.f = b.rel_path), {moved_sql('b.rel_path', 'mv')}) as rel_path, is_dir from base b
  where file_id not in (select file_id from noted) and file_id not in (select file_id from final where stage = 7 and file_id is not null))
select * from noted union all select * from stay where rel_path not in (select rel_path from noted)"""))
def tree_commit(spark, d):
    """The base after the whole plan for trees has run stage by stage, with its journal, in a store."""
    sides, t = _sides(spark, d)
    plan, _ = planner.planned_tree(planner.Tree(t["base"], t["loc"], t["rem"], "test_box", F.expr(NOW), t["shad"], t["unread"], case_fold=True, prefer_newer=True))
    store = Store(spark, f"{shared(spark)}/trellis/commit-{uuid.uuid4().hex}")
    store.commit(vars(sides))
    run = commit.Run(store)
    run.begin(planner.numbered(plan, planner.run_order()))
    run.all()
    return store.table("base").select("file_id", "rel_path", "is_dir")


@query(tree_sql(f""", o as ({ORDERED}), bad as (select distinct rel_path from o where type in ('conflict_backup', 'move_remote') and not is_dir),
l0 as (select ord, rel_path, 'failed' as why from o where rel_path in (select rel_path from bad)),
l1 as (select ord, rel_path, 'refused' as why from o where protected_by in (select rel_path from l0) and ord not in (select ord from l0)),
l2 as (select ord, rel_path, 'refused' as why from o where protected_by in (select rel_path from l1) and ord not in (select ord from l0 union all select ord from l1))
select ord, why from l0 union all select ord, why from l1 union all select ord, why from l2"""))
def tree_refusals(spark, d):
    """What doesn't run once all backups and moves on the remote side fail: these, and what they protect."""
    t = trees(spark, d)
    plan, _ = planner.planned_tree(planner.Tree(t["base"], t["loc"], t["rem"], "test_box", F.expr(NOW), t["shad"], t["unread"], case_fold=True, prefer_newer=True))
    plan = staged(planner.numbered(plan, planner.run_order()), "plan")
    failed = plan.where("type in ('conflict_backup', 'move_remote') and not is_dir").select("rel_path").distinct()
    return commit.failing(plan, failed)


def _plan(spark, d):
    t = trees(spark, d)
    return planner.planned_tree(planner.Tree(t["base"], t["loc"], t["rem"], "test_box", F.expr(NOW), t["shad"], t["unread"], case_fold=True, prefer_newer=True)), t


_GATHERED = f"{COLLAPSED}".replace("select f.stage, f.type, f.rel_path,", "select f.stage, f.type, f.rel_path, f.new_rel_path,", 1)


def _told(which: str) -> str:
    """What the log says of the types of actions, by the names that the report functions give them."""
    table = R.KINDS if which == "kind" else R.SOURCES
    return "case " + " ".join(f"when type in ({', '.join(repr(x) for x in types)}) then '{name}'" for name, types in table.items()) + " end"


@query(tree_sql(_GATHERED.replace("select f.stage", f"select {_told('kind')} as kind, rel_path, case when new_rel_path is not null then concat('-> ', new_rel_path) when subtree_files > 0 then concat('(', cast(subtree_files as varchar), ' files)') else '' end as detail, {_told('source')} as source from (select f.stage", 1) + f") z where {_told('kind')} is not null"))
def tree_log(spark, d):
    """What a cycle that went well adds to the log, deleted directories with the number of their files."""
    (plan, _), t = _plan(spark, d)
    gathered = planner.collapsed_tree(plan, t["rem"])[0]
    return status.cycle_log(gathered, spark.createDataFrame([], "rel_path string, error string"), False, True)


@query(tree_sql(", bad as (select distinct rel_path from final where type = 'conflict_backup') select 'error' as kind, rel_path, concat('can''t move ', rel_path) as detail, '' as source from bad"))
def tree_errors(spark, d):
    """What a cycle that failed in part adds to the log: the errors alone."""
    (plan, _), _ = _plan(spark, d)
    plan = staged(plan, "plan")
    failed = plan.where("type = 'conflict_backup'").select("rel_path").distinct().withColumn("error", F.concat(F.lit("can't move "), "rel_path"))
    return status.cycle_log(plan, failed, False, True)


@query(tree_sql(""", n as (select cast(count(*) filter (where type = 'quarantine_local') as bigint) as l, cast(count(*) filter (where type = 'trash_remote') as bigint) as r from final where not is_dir), t as (select count(*) as n from base where not is_dir)
select l as deleted_local, r as deleted_remote, greatest(l, r) > 10 and greatest(l, r) * 50 > t.n as large from n, t"""))
def tree_deletions(spark, d):
    (plan, _), t = _plan(spark, d)
    return status.deletions(planner.collapsed_tree(plan, t["rem"])[0], t["base"].where("not is_dir").count(), 0.02, 0)


@query(tree_sql("select *, row_number() over (order by rel_path, reason) as ord from skips"))
def skips_sorted(spark, d):
    (_, skips), _ = _plan(spark, d)
    return planner.numbered(skips, [F.col("rel_path"), F.col("reason")])


@query(tree_sql("select type, rel_path, row_number() over (order by type, rel_path) as ord from final where type in ('conflict_backup', 'quarantine_local') and not is_dir"))
def report_sorted(spark, d):
    """The paths that the report of a merge lists: conflicts and what was put aside, each list in order."""
    (plan, _), _ = _plan(spark, d)
    listed = plan.where("type in ('conflict_backup', 'quarantine_local') and not is_dir").select("type", "rel_path")
    return planner.numbered(listed, [F.col("type"), F.col("rel_path")])


@query(sql_text(f"with {NODES} select parent_id, name, cast(count(*) as bigint) as n, min(file_id) as kept from nodes group by parent_id, name having count(*) > 1"))
def duplicate_names(spark, d):
    """Names that a directory has several times, and whose id stays."""
    return trees_of.duplicates(nodes(spark, d))


@query(_SINCE.format(columns="n as failures, cast(case when n <= 0 then 45 else 45 * pow(2, least(n - 1, 4)) end as bigint) as wait", counted="event_type in ('error', 'signup')", reset="event_type not in ('error', 'signup')"))
def failure_backoff(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    found = watching.latched(events, "user_id", "event_id", F.col("event_type").isin("error", "signup"))
    return found.select("user_id", "event_id", "failures", status.backoff(F.col("failures"), 45).cast("long").alias("wait"))


@query("""select user_id, min(ts) as "first", max(ts) as "last", cast(count(*) as bigint) as n from (
  select *, sum(case when prev is null or epoch_us(ts) - epoch_us(prev) >= 86400000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as g from (select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events) a) b group by user_id, g""")
def event_bursts(spark, d):
    """Events of a user that are less than a day apart, as one."""
    return debounced(table(spark, d, "events"), "ts", "1 day", "1 day", "user_id")


_OWN_RULES = " union all ".join(f"select doc_id as id, line, '{name}' as rule from l where regexp_matches(t, '{rule}')" for name, rule in audit.SECRET_RULES.items())


@query(f"with s as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null), l as (select doc_id, cast(i as bigint) as line, ls[i] as t from s, lateral (select unnest(range(1, len(ls) + 1)) as i) u) {_OWN_RULES}")
def secret_lines_own_rules(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return audit.secret_lines(docs.where("text is not null"))


@query("select o_orderkey, concat('/bin/', strftime(o_orderdate, '%Y-%m-%d'), '/d', cast(o_custkey as varchar), '/o.txt') as path from orders")
def rescue_paths(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", R.rescue_path("/bin", F.col("o_orderdate").cast("timestamp"), F.concat(F.lit("d"), F.col("o_custkey").cast("string"), F.lit("/o.txt"))).alias("path"))


@query("""with m as (select cast(count(*) as bigint) as tracked_items, cast(count(*) filter (where event_type = 'error') as bigint) as pending_ops, max(event_id) as last_sync_at from events),
r as (select '[' || string_agg('{"kind":"' || event_type || '","user_id":' || cast(user_id as varchar) || '}', ',' order by event_id desc) || ']' as a from (select * from events order by event_id desc limit 5) t)
select '{"tracked_items":' || tracked_items || ',"pending_ops":' || pending_ops || ',"last_sync_at":' || last_sync_at || ',"recent_activity":' || a || '}' as json from m, r""")
def status_json(spark, d):
    events = table(spark, d, "events")
    machine = events.agg(F.count("*").alias("tracked_items"), F.count_if(F.col("event_type") == "error").alias("pending_ops"), F.max("event_id").alias("last_sync_at"))
    return status.status_view(machine, events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "user_id"))


@query("""select '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as json, row_number() over (order by event_id desc) as ord from (select * from events order by event_id desc limit 50) t""")
def activity_file(spark, d):
    """The newest entries of the log as the file that the sink leaves, read again."""
    newest = feed_ops.recent(table(spark, d, "events").select("event_id", "event_type"), 50, "event_id")
    rows = newest.select(F.row_number().over(Window.orderBy(F.col("event_id").desc())).cast("long").alias("ord"), F.to_json(F.struct("event_id", "event_type")).alias("json"))
    folder = f"{shared(spark)}/trellis/view-{uuid.uuid4().hex}"
    write_view(rows, folder, "activity")
    lines = spark.read.text(f"{folder}/activity.json", wholetext=True)
    return lines.select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("pos", "json")).select("json", (F.col("pos") + 1).cast("long").alias("ord"))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50 and l_linenumber = 1)")
def clustered_lookup(spark, d):
    """Orders of some lines, from a layout in which a lookup opens the files of its keys alone."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    keys = table(spark, d, "lineitem").where("l_quantity = 50 and l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return clustered(orders, "o_orderkey", 16).lookup(keys)
