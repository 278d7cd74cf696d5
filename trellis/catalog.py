"""Every query of the reconciliation side by name, with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions import paths as P
from trellis.functions import reports as R
from trellis.operators import audit, feed, reconcile
from trellis.operators import nodes as trees
from trellis.plans.fixtures import COARSE, NODES, NOW, SNAPSHOTS, nodes, snapshots, sql_text
from trellis import listing_catalog, live_catalog, state_catalog, tree_catalog
from trellis.sources.tables import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = tree_catalog.QUERIES | state_catalog.QUERIES | listing_catalog.QUERIES | live_catalog.QUERIES
SQL: dict[str, str] = tree_catalog.SQL | state_catalog.SQL | listing_catalog.SQL | live_catalog.SQL


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql_text(sql)
        return f

    return add


def now():
    return F.expr(NOW)


_CLASS = """
  select case when l.rel_path is null and r.file_id is null then 'forget'
              when l.rel_path is null and (r.md5 <> b.md5 or r.rel_path <> b.rel_path) then 'restore_remote'
              when l.rel_path is null then 'trash_remote'
              when r.file_id is null and l.md5 <> b.md5 then 'resurrect' when r.file_id is null then 'quarantine'
              when l.md5 = b.md5 and r.md5 = b.md5 then 'noop_or_record' when r.md5 = b.md5 then 'update_remote'
              when l.md5 = b.md5 then 'download' when l.md5 = r.md5 then 'record_same' else 'conflict' end as row_cls
  from base b left join loc l on l.rel_path = b.rel_path left join rem r on r.file_id = b.file_id
  union all
  select case when r.file_id is null then 'upload_new' when l.rel_path is null then 'download_new' when l.md5 = r.md5 then 'adopt' else 'conflict_new' end
  from (select * from loc where rel_path not in (select rel_path from base)) l
  full outer join (select * from rem where file_id not in (select file_id from base)) r on l.rel_path = r.rel_path"""


@query(f"with {SNAPSHOTS} select row_cls, cast(count(*) as bigint) as n from ({_CLASS}) t group by row_cls")
def three_way_classify(spark, d):
    return reconcile.classified(*snapshots(spark, d))


_COPY = "concat(substr({p}, 1, length({p}) - 4), ' (conflict test_box 2026-07-08_103000).txt')"
_PLAN = """,
b1 as (
  select b.file_id, b.rel_path as p, b.md5 as bm, b.size as bs, l.md5 as lm, r.rel_path as rp, r.md5 as rm, r.version as rv, l.size as ls, o.md5 as om,
         l.rel_path is not null as has_l, r.file_id is not null as has_r, coalesce(r.rel_path <> b.rel_path, false) as mv,
         o.rel_path is not null and t.rel_path is null as displaced, t.rel_path is not null as tracked,
         n.file_id as nid, n.md5 as nm
  from base b left join loc l on l.rel_path = b.rel_path left join rem r on r.file_id = b.file_id
  left join loc o on o.rel_path = r.rel_path and r.rel_path <> b.rel_path left join base t on t.rel_path = r.rel_path and r.rel_path <> b.rel_path
  left join (select * from rem where file_id not in (select file_id from base)) n on n.rel_path = b.rel_path and l.rel_path is not null and r.file_id is null),
b2 as (select *, has_l and lm <> bm as lc, has_r and rm <> bm as rc, not has_l and mv and displaced as met, has_l and has_r and lm <> bm and rm <> bm and lm <> rm as clash from b1),
nl as (select * from loc where rel_path not in (select rel_path from base) and rel_path not in (select rp from b2 where met or (mv and has_l and not clash and displaced))),
nr as (select * from rem where file_id not in (select file_id from base)),
j as (select l.rel_path as p, l.md5 as lm, l.size as sz, n.file_id as nid, n.md5 as nm from nl l left join nr n on n.rel_path = l.rel_path),
gone as (select p, file_id, bm, bs, row_number() over (partition by bm, bs order by p) as k from b2 where not has_l and has_r and not rc and not mv),
lone as (select p, lm, sz, row_number() over (partition by lm, sz order by p) as k from j where nid is null),
pr as (select g.p as src, d.p as dst, g.file_id from gone g join lone d on g.bm = d.lm and g.bs = d.sz and g.k = d.k),
tri as (
  select p as spot, case when mv then rp else p end as dst, file_id as id from b2 where clash
  union all select rp, rp, file_id from b2 where met and om <> rm
  union all select p, p, nid from b2 where not has_r and lc and nid is not null and nm <> lm
  union all select p, p, nid from j where nid is not null and lm <> nm),
plan as (
  select 5 as stage, 'conflict_backup' as type, spot as rel_path, COPY(spot) as new_rel_path, cast(null as varchar(1)) as file_id, cast(null as varchar(1)) as protected_by from tri
  union all select 6, 'upload', COPY(spot), null, null, spot from tri
  union all select 6, 'download', dst, null, id, spot from tri
  union all select 5, 'conflict_backup', rp, COPY(rp), null, null from b2 where mv and has_l and not clash and displaced
  union all select 6, 'upload', COPY(rp), null, null, rp from b2 where mv and has_l and not clash and displaced
  union all select 5, 'move_local', p, rp, file_id, case when displaced then rp end from b2 where mv and has_l and not clash
  union all select 6, 'record', rp, null, file_id, null from b2 where met and om = rm
  union all select 7, 'forget', p, null, file_id, null from b2 where not has_l and not has_r
  union all select 6, 'download', case when mv then rp else p end, null, file_id, null from b2 where not met and not has_l and has_r and (rc or mv)
  union all select 6, 'record', p, null, nid, null from b2 where not has_r and lc and nid is not null and nm = lm
  union all select 6, 'upload', p, null, null, null from b2 where has_l and not has_r and lc and nid is null
  union all select 7, 'quarantine_local', p, null, file_id, null from b2 where has_l and not has_r and not lc and nid is null
  union all select 6, 'record', case when mv then rp else p end, null, file_id, case when mv then p end from b2 where has_l and has_r and not lc and not rc and (bs <> ls or rv <> 1)
  union all select 6, 'update_remote', case when mv then rp else p end, null, file_id, case when mv then p end from b2 where has_l and has_r and lc and not rc
  union all select 6, 'download', case when mv then rp else p end, null, file_id, null from b2 where has_l and has_r and not lc and rc
  union all select 6, 'record', case when mv then rp else p end, null, file_id, case when mv then p end from b2 where has_l and has_r and lc and rc and lm = rm
  union all select 6, 'record', p, null, nid, null from j where nid is not null and lm = nm
  union all select 5, 'move_remote', src, dst, file_id, null from pr
  union all select 6, 'upload', p, null, null, null from j where nid is null and p not in (select dst from pr)
  union all select 7, 'trash_remote', p, null, file_id, null from gone where p not in (select src from pr)
  union all select 6, 'download', rel_path, null, file_id, null from nr where rel_path not in (select p from j where nid is not null) and rel_path not in (select p from b2 where nid is not null and lc))"""
for _c in ("spot", "rp"):
    _PLAN = _PLAN.replace(f"COPY({_c})", _COPY.replace("{p}", _c))


def plan_of(spark, d, of=None):
    return reconcile.planned(*snapshots(spark, d, of), "test_box", now())


@query(f"with {SNAPSHOTS} {_PLAN} select * from plan")
def plan_ordered(spark, d):
    return reconcile.ordered(plan_of(spark, d))


QUERIES["plan_shared_content"] = lambda spark, d: reconcile.ordered(plan_of(spark, d, COARSE))
SQL["plan_shared_content"] = sql_text(f"with {SNAPSHOTS} {_PLAN} select * from plan", COARSE)


@query(f"with {SNAPSHOTS} {_PLAN} select type, cast(count(*) as bigint) as n from plan group by type")
def merge_summary(spark, d):
    return reconcile.summary(plan_of(spark, d))


@query(f"""with {SNAPSHOTS} {_PLAN}, n as (select cast(count(*) filter (where type = 'quarantine_local') as bigint) as deletions from plan), t as (select cast(count(*) as bigint) as tracked from base)
select deletions, tracked, deletions > 10 and deletions * 100 > tracked * 3 as tripped from n, t""")
def mass_delete_guard(spark, d):
    return reconcile.mass_delete_guard(plan_of(spark, d), snapshots(spark, d)[0], 0.03, confirmed=False, bin_available=False)


@query(f"""with {SNAPSHOTS} {_PLAN}, t as (select rel_path from plan where type in ('upload', 'update_remote', 'download', 'record'))
select rel_path, 'twice' as problem from t group by rel_path having count(*) > 1
union all select distinct a.rel_path, 'beneath' from t a join t b on starts_with(a.rel_path, concat(b.rel_path, '/'))""")
def validate(spark, d):
    return reconcile.overlaps(plan_of(spark, d))


_DOOMED = "((cast(substr(split_part(rel_path, '/', 1), 2) as int) + 3 * cast(substr(split_part(rel_path, '/', 2), 2) as int)) % 5 <= 1 or rel_path like 'd1/%')"


def _deletes(spark, d):
    base = snapshots(spark, d)[0].select("rel_path", F.expr(_DOOMED).alias("doomed"))
    return base.where("doomed").select("rel_path"), base.where("not doomed").select("rel_path")


@query(f"""with {SNAPSHOTS},
f as (select rel_path, {_DOOMED} as doomed, split_part(rel_path, '/', 1) as top, concat(split_part(rel_path, '/', 1), '/', split_part(rel_path, '/', 2)) as dir from base),
alive as (select * from f where not doomed)
select case when top not in (select top from alive) then top when dir not in (select dir from alive) then dir else rel_path end as root, count(*) as files
from f where doomed group by 1""")
def collapse(spark, d):
    return reconcile.collapsed(*_deletes(spark, d))


@query(f"""with {SNAPSHOTS},
s as (select p, bm, bs, file_id, row_number() over (partition by bm, bs order by p) as k from (
  select b.rel_path as p, b.md5 as bm, b.size as bs, b.file_id from base b left join loc l on l.rel_path = b.rel_path join rem r on r.file_id = b.file_id
  where l.rel_path is null and r.md5 = b.md5 and r.rel_path = b.rel_path)),
t as (select rel_path as p, md5, size, row_number() over (partition by md5, size order by rel_path) as k from loc where rel_path not in (select rel_path from base))
select s.p as "from", t.p as "to", s.file_id, s.bm as md5, s.bs as size from s join t on s.bm = t.md5 and s.bs = t.size and s.k = t.k""".replace("{content}", COARSE["content"]).replace("{size}", COARSE["size"]))
def move_pairing(spark, d):
    base, local, remote = snapshots(spark, d, COARSE)
    rows = reconcile.aligned(base, local, remote).where(~F.col("in_l") & F.col("in_r") & (F.col("r_md5") == F.col("b_md5")) & (F.col("r_rel_path") == F.col("b_rel_path")))
    gone = rows.select(F.col("b_rel_path").alias("path"), F.col("b_file_id").alias("file_id"), F.col("b_md5").alias("md5"), F.col("b_size").alias("size"))
    return reconcile.move_pairs(gone, local.join(base, "rel_path", "left_anti").select(F.col("rel_path").alias("path"), "md5", "size"))


@query(f"with {SNAPSHOTS} select l.rel_path, r.file_id, l.md5 from loc l join rem r on r.rel_path = l.rel_path and r.md5 = l.md5 where l.rel_path not in (select rel_path from base) and r.file_id not in (select file_id from base)")
def adopt(spark, d):
    return audit.adoptable(*snapshots(spark, d))


@query(f"with {SNAPSHOTS} select rel_path, {_COPY.replace('{p}', 'rel_path')} as new_name, length(rel_path) - length(replace(rel_path, '/', '')) as depth, regexp_replace(rel_path, '/[^/]*$', '') as dir from base")
def conflict_names(spark, d):
    p = F.col("rel_path")
    return snapshots(spark, d)[0].select("rel_path", P.conflict_name(p, "test_box", now()).alias("new_name"), P.depth(p).cast("long").alias("depth"), P.dirname(p).alias("dir"))


def _moves(spark):
    return spark.createDataFrame([("d1", "x"), ("d1/e2", "y/z"), ("d2", "d1/in"), ("d3/e4/none", "w"), ("d40/e1", "v")], "from string, to string")


@query(f"""with {SNAPSHOTS}, m as (select * from (values ('d1', 'x'), ('d1/e2', 'y/z'), ('d2', 'd1/in'), ('d3/e4/none', 'w'), ('d40/e1', 'v')) t(f, t)),
h as (select b.rel_path, m.f, m.t, row_number() over (partition by b.rel_path order by length(m.f) desc) as k from base b join m on starts_with(b.rel_path, concat(m.f, '/')))
select b.rel_path, case when h.f is null then b.rel_path else concat(h.t, substr(b.rel_path, length(h.f) + 1)) end as now from base b left join h on h.rel_path = b.rel_path and h.k = 1""")
def longest_prefix_rewrite(spark, d):
    return reconcile.rewritten(snapshots(spark, d)[0].select("rel_path"), _moves(spark))


@query(f"with {SNAPSHOTS} select distinct b.rel_path from base b join (select distinct regexp_replace(rel_path, '/[^/]*$', '') as dir from rem where version = 2) r on starts_with(b.rel_path, concat(r.dir, '/'))")
def under_dir_semi(spark, d):
    base, _, remote = snapshots(spark, d)
    dirs = remote.where("version = 2").select(P.dirname(F.col("rel_path")).alias("dir")).distinct()
    return base.select("rel_path", F.explode(P.proper_ancestors(F.col("rel_path"))).alias("dir")).join(dirs, "dir", "left_semi").select("rel_path").distinct()


@query(f"""with {SNAPSHOTS}
select 'missing_local' as category, rel_path from base where rel_path not in (select rel_path from loc)
union all select 'differs_local', b.rel_path from base b join loc l on l.rel_path = b.rel_path where l.md5 <> b.md5
union all select 'missing_remote', rel_path from base where file_id not in (select file_id from rem)
union all select 'differs_remote', b.rel_path from base b join rem r on r.file_id = b.file_id where r.md5 <> b.md5
union all select 'untracked_local', rel_path from loc where rel_path not in (select rel_path from base)
union all select 'untracked_remote', rel_path from rem where file_id not in (select file_id from base)""")
def doctor_report(spark, d):
    return audit.divergence(*snapshots(spark, d))


@query(f"""with recursive {NODES}, t as (
  select file_id, name as rel_path, 1 as depth from nodes where parent_id = 'root'
  union all select n.file_id, concat(t.rel_path, '/', n.name), t.depth + 1 from t join nodes n on n.parent_id = t.file_id)
select * from t""")
def tree_paths(spark, d):
    return trees.tree_paths(nodes(spark, d), "root")


@query(f"""with recursive {NODES}, t as (select file_id from nodes where parent_id = 'root' union all select n.file_id from t join nodes n on n.parent_id = t.file_id)
select file_id, parent_id, name from nodes where file_id not in (select file_id from t)""")
def prune(spark, d):
    return trees.pruned(nodes(spark, d), "root")


_SIBLINGS = "select file_id, parent_id, name, case when n = 1 then 'kept' when name = f then 'duplicate' else 'collision' end as verdict from (select *, row_number() over w as n, first_value(name) over w as f from nodes window w as (partition by parent_id, {key} order by file_id)) t"


@query(f"with {NODES} {_SIBLINGS.replace('{key}', 'name')}")
def dup_first_by_id(spark, d):
    return trees.siblings(nodes(spark, d), F.col("name"))


@query(f"with {NODES} {_SIBLINGS.replace('{key}', 'lower(name)')}")
def fold_dedup(spark, d):
    return trees.siblings(nodes(spark, d), P.fold_key(F.col("name"), True, False))


@query(f"with {NODES} {_SIBLINGS.replace('{key}', 'nfc_normalize(lower(nfc_normalize(name)))')}")
def fold_dedup_normalized(spark, d):
    return trees.siblings(nodes(spark, d), P.fold_key(F.col("name"), True, True))


def _events(spark, d):
    return table(spark, d, "events")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) t where k = 1")
def feed_latest(spark, d):
    return feed.latest(_events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""with s as (select c_custkey as user_id, c_mktsegment as event_type from customer), l as (select user_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as k from events) t where k = 1)
select * from s where user_id not in (select user_id from l) union all select * from l where event_type <> 'error'""")
def feed_apply(spark, d):
    state = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("event_type"))
    return feed.applied(state, _events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")


_FOLD = "select event_type, min(event_id) as first, max(epoch_us(ts)) as ts, cast(count(*) as bigint) as count from (select *, sum(case when event_type = prev then 0 else 1 end) over (order by event_id) as run from (select *, lag(event_type) over (order by event_id) as prev from events) a) b group by run, event_type"


def _fold(spark, d):
    log = _events(spark, d).select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return feed.folded(log, ["event_type"], "event_id", "us")


@query(_FOLD)
def activity_fold(spark, d):
    return _fold(spark, d)


@query(f"select * from ({_FOLD}) f order by first desc limit 500")
def activity_ring(spark, d):
    return feed.ring(_fold(spark, d), order="first")


@query("select event_id, event_type, user_id from events order by event_id desc limit 20")
def recent_topn(spark, d):
    return feed.recent(_events(spark, d).select("event_id", "event_type", "user_id"), 0, "event_id")


@query("select event_id, event_type, user_id from events where event_type = 'error' and (contains(lower(props), '1%') or contains(lower(event_type), '1%') or contains(lower(cast(user_id as varchar)), '1')) ")
def activity_search(spark, d):
    e = _events(spark, d)
    e = e.where(feed.direction(F.col("event_type"), F.col("event_type"), "error"))
    return e.where(feed.matching([F.col("props"), F.col("event_type")], "1%") | feed.matching([F.col("user_id").cast("string")], "1")).select("event_id", "event_type", "user_id")


@query("""with r as (select user_id, event_type <> 'error' as ok, sum(case when (event_type = 'error') is distinct from prev then 1 else 0 end) over (partition by user_id order by event_id) as run
from (select *, lag(event_type = 'error') over (partition by user_id order by event_id) as prev from events) a)
select user_id, cast(count(*) as bigint) as n from (select user_id, run from r where not ok group by user_id, run having count(*) >= 2) t group by user_id""")
def failure_latch(spark, d):
    return feed.failures(_events(spark, d), F.col("event_type") != "error", "event_id", "user_id", 2)


@query("select c_custkey, case when c_custkey % 5 = 0 then 'running' when c_custkey % 3 = 0 then 'never-run' when c_custkey % 2 = 0 then 'stopped' when c_custkey % 61 > 30 then 'stale' else 'running' end as state from customer")
def daemon_state(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, audit.daemon_state(k % 5 == 0, k % 3, k % 2 == 1, F.lit(1000) - k % 61, F.lit(1000)).alias("state"))


@query("select o_orderkey, case when o_orderkey % 97 * 991 < 60 then concat(cast(o_orderkey % 97 * 991 as varchar), 's') when o_orderkey % 97 * 991 < 3600 then concat(cast(o_orderkey % 97 * 991 // 60 as varchar), 'm') when o_orderkey % 97 * 991 < 86400 then concat(cast(o_orderkey % 97 * 991 // 3600 as varchar), 'h', cast(o_orderkey % 97 * 991 % 3600 // 60 as varchar), 'm') else concat(cast(o_orderkey % 97 * 991 // 86400 as varchar), 'd', cast(o_orderkey % 97 * 991 % 86400 // 3600 as varchar), 'h') end as age from orders")
def duration_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.duration_text(F.col("o_orderkey") % 97 * 991).alias("age"))


@query("with b as (select o_orderkey, case when o_orderkey % 7 = 0 then md5('old') else md5(o_orderpriority) end as known, o_orderkey % 7 = 0 or o_orderkey % 5 = 0 as drift from orders) select concat('o', cast(b.o_orderkey as varchar)) as rel_path, case when o.o_orderkey % 5 = 0 or o.o_orderkey % 11 = 0 then md5(o_orderpriority) else known end as md5, not (o.o_orderkey % 5 = 0 or o.o_orderkey % 11 = 0) as reused from b join orders o on o.o_orderkey = b.o_orderkey")
def hash_on_drift(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("o"), k.cast("string")).alias("rel_path")
    files = o.select(path, (k % 97).alias("size"), k.alias("mtime_ns"), F.col("o_orderpriority").alias("content"))
    known = F.when(k % 7 == 0, F.md5(F.lit("old").cast("binary"))).otherwise(F.md5(F.col("o_orderpriority").cast("binary")))
    base = o.where(k % 11 != 0).select(path, (k % 97).alias("size"), F.when(k % 5 == 0, k - 1).otherwise(k).alias("mtime_ns"), known.alias("md5"))
    return audit.hashed_on_drift(files, base)


_RULES = {"akia": r"AKIA[0-9A-Z]{16}", "password": r"password=[0-9a-f]{6,}", "card": r"[0-9]{16}"}


@query("select doc_id as id, line, rule from (select doc_id, unnest(string_split(text, chr(10))) as t, cast(generate_subscripts(string_split(text, chr(10)), 1) as bigint) as line from documents) l, (values " + ", ".join(f"('{k}', '{p}')" for k, p in _RULES.items()) + ") r(rule, pattern) where regexp_matches(t, pattern)")
def secret_scan(spark, d):
    return audit.secret_lines(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _RULES)


@query("select concat(cast(o_orderdate as date)::varchar, case when o_orderkey % 6 = 0 then 'x' else '' end) as name, o_orderkey from orders where o_orderkey % 6 <> 0 and cast(o_orderdate as date) < date '1997-01-01' - 30")
def retention_purge(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 6 == 0, "x").otherwise("")).alias("name"), "o_orderkey")
    return o.where(audit.expired(F.col("name"), F.lit("1997-01-01").cast("date"), 30))


@query("select doc_id, trim(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\x{0B}]+', ' ', 'g')) as line, case when length(text) > 40 then concat(left(text, 39), '…') else text end as clipped from documents")
def report_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", P.one_line(F.col("text")).alias("line"), P.clip(F.col("text"), 40).alias("clipped"))


@query(f"""with {SNAPSHOTS} {_PLAN},
written as (
  select p.file_id, p.rel_path, r.md5 from plan p join rem r on r.file_id = p.file_id where p.type in ('download', 'record')
  union all select p.file_id, p.rel_path, l.md5 from plan p join loc l on l.rel_path = coalesce(p.protected_by, p.rel_path) where p.type = 'update_remote'
  union all select concat('up:', p.rel_path), p.rel_path, l.md5 from plan p left join plan b on b.type = 'conflict_backup' and b.new_rel_path = p.rel_path
    join loc l on l.rel_path = coalesce(b.rel_path, p.rel_path) where p.type = 'upload'),
fresh as (
  select * from written
  union all select p.file_id, p.new_rel_path, b.md5 from plan p join base b on b.file_id = p.file_id
    where p.type in ('move_local', 'move_remote') and p.file_id not in (select file_id from written))
select file_id, rel_path, md5 from base where file_id not in (select file_id from plan where type in ('forget', 'trash_remote', 'quarantine_local'))
  and file_id not in (select file_id from fresh) and rel_path not in (select rel_path from fresh)
union all select * from fresh""")
def apply_baseline(spark, d):
    base, local, remote = snapshots(spark, d)
    return reconcile.applied(base, local, remote, plan_of(spark, d))


@query(f"""with {SNAPSHOTS} {_PLAN}, a as (
  select case when type in ('upload', 'update_remote', 'trash_remote', 'move_remote') then 'local' when type in ('download', 'quarantine_local', 'move_local') then 'remote' when type = 'conflict_backup' then 'conflict' end as source,
         case type when 'upload' then 'upload' when 'update_remote' then 'update' when 'download' then 'download' when 'trash_remote' then 'trash' when 'quarantine_local' then 'trash' when 'move_local' then 'move' when 'move_remote' then 'move' when 'conflict_backup' then 'conflict' end as kind,
         rel_path, case when new_rel_path is null then '' else concat('-> ', new_rel_path) end as detail from plan)
select * from a where kind is not null""")
def activity_of_plan(spark, d):
    t = F.col("type")
    rows = plan_of(spark, d).where(R.kind(t).isNotNull())
    return rows.select(R.source(t).alias("source"), R.kind(t).alias("kind"), "rel_path", R.detail(F.col("new_rel_path"), F.lit(0)).alias("detail"))


@query("""select p_partkey, case when regexp_replace(replace(replace(p_name, '.', '_'), ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') = '' then 'unknown_machine' else regexp_replace(replace(replace(p_name, '.', '_'), ' ', '_'), '[^A-Za-z0-9_-]', '', 'g') end as machine,
case when length(p_name) < 14 then rpad(p_name, 14, ' ') else p_name end as padded, case when length(p_name) > 9 then concat(left(p_name, 8), '…') else p_name end as cut, case when length(p_name) > 9 then concat('…', right(p_name, 8)) else p_name end as tail,
format('{:,}', p_partkey * 977) as n, case when p_size < 2 then '' else concat(' (×', cast(p_size as varchar), ')') end as times, case when p_size % 3 < 2 then concat(p_type, '.txt') else concat(p_type, '.', cast(p_size % 3 as varchar), '.txt') end as numbered from part""")
def report_labels(spark, d):
    name, n = F.col("p_name"), F.col("p_size")
    texts = {"machine": R.machine_name(name), "padded": R.pad(name, 14), "cut": R.truncated(name, 9), "tail": R.truncated(name, 9, "right"), "n": R.thousands(F.col("p_partkey") * 977)}
    texts |= {"times": R.repeat_suffix(n), "numbered": R.numbered(F.concat("p_type", F.lit(".txt")), n % 3)}
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in texts.items()])
