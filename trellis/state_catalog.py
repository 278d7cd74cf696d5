"""The queries over journals, mirrors and the read model, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from trellis.functions import paths as P
from trellis.operators import state, status
from trellis.plans.fixtures import NOW
from trellis.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_OPS = "select l_orderkey * 10 + l_linenumber as op_id, case l_returnflag when 'A' then 'planned' when 'R' then 'in_progress' else 'done' end as state from lineitem"


def _journal(spark, d):
    flag = F.col("l_returnflag")
    state_ = F.when(flag == "A", "planned").when(flag == "R", "in_progress").otherwise("done")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op_id"), state_.alias("state"))


@query(f"with j as ({_OPS}) select op_id, case max(case state when 'planned' then 1 when 'in_progress' then 2 else 3 end) when 1 then 'planned' when 2 then 'in_progress' else 'done' end as state from j group by op_id having max(case state when 'planned' then 1 when 'in_progress' then 2 else 3 end) < 3")
def journal_stale(spark, d):
    return state.stale(state.current(_journal(spark, d)))


@query(f"with j as ({_OPS}), c as (select op_id, max(case state when 'planned' then 1 when 'in_progress' then 2 else 3 end) as s from j group by op_id) select cast(count(*) filter (where s < 3) as bigint) as pending from c")
def journal_pending(spark, d):
    return state.pending(state.current(_journal(spark, d)))


_NATION = "with b as (select r_name as rel_path, concat('r', cast(r_regionkey as varchar)) as file_id from region union all select concat(r_name, '/', n_name), concat('n', cast(n_nationkey as varchar)) from nation join region on r_regionkey = n_regionkey where n_nationkey % 4 <> 0)"


def _dirs(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    top = r.select(F.col("r_name").alias("rel_path"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("file_id"))
    return top.union(n.where("n_nationkey % 4 <> 0").join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))


def _customers(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))


_PARENTS = f"{_NATION}, f as (select case when c_custkey % 7 = 0 then c_name else concat(r_name, '/', n_name, '/', c_name) end as rel_path, c_custkey as k from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"


@query(f"{_PARENTS} select f.rel_path, case when not contains(f.rel_path, '/') then 'root' else b.file_id end as parent_id from f left join b on b.rel_path = regexp_replace(f.rel_path, '/[^/]*$', '')")
def parent_lookup(spark, d):
    path = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat_ws("/", "r_name", "n_name", "c_name"))
    return state.with_parent(_customers(spark, d).select(path.alias("rel_path")), _dirs(spark, d), "root")


@query("with recursive " + _NATION.removeprefix("with ") + """, o as (
  select concat(r_name, '/', n_name) as rel_path, 'mkdir_remote' as t from nation join region on r_regionkey = n_regionkey where n_nationkey % 4 = 0
  union all select concat(r_name, '/', n_name, '/', c_name), 'upload' from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_custkey % 3 = 0),
nd as (select concat('n', cast(n_nationkey as varchar)) as file_id, concat('r', cast(n_regionkey as varchar)) as parent_id, n_name as name from nation where n_nationkey % 8 = 0
  union all select concat('c', cast(c_custkey as varchar)), concat('n', cast(c_nationkey as varchar)), c_name from customer where c_custkey % 5 = 0),
t as (select rel_path, file_id from b union all select o.rel_path, n.file_id from t join nd n on n.parent_id = t.file_id join o on o.rel_path = concat(t.rel_path, '/', n.name))
select distinct rel_path, file_id from t where rel_path in (select rel_path from o)""")
def journal_recovery(spark, d):
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), _customers(spark, d)
    made = n.where("n_nationkey % 4 = 0").join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name").alias("rel_path"), F.lit("mkdir_remote").alias("op_type"))
    ops = made.union(c.where("c_custkey % 3 = 0").select(F.concat_ws("/", "r_name", "n_name", "c_name"), F.lit("upload")))
    ops = ops.select(F.xxhash64("rel_path").alias("op_id"), "op_type", "rel_path", F.lit("in_progress").alias("state"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = n.where("n_nationkey % 8 = 0").select(name("n", "n_nationkey").alias("file_id"), name("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    nodes = nodes.union(table(spark, d, "customer").where("c_custkey % 5 = 0").select(name("c", "c_custkey"), name("n", "c_nationkey"), "c_name"))
    return state.made_but_unrecorded(ops, _dirs(spark, d), nodes, "root")


_BASE = "b as (select o_orderkey as file_id, concat('p', cast(o_orderkey as varchar)) as rel_path, o_custkey as v from orders where o_orderkey % 5 <> 0), r as (select o_orderkey as file_id, concat('p', cast(case when o_orderkey % 7 = 0 then o_orderkey + 1 else o_orderkey end as varchar)) as rel_path, o_custkey + 1 as v from orders where o_orderkey % 3 = 0)"


def _base(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    path = lambda c: F.concat(F.lit("p"), c.cast("string")).alias("rel_path")
    rows = o.where(k % 3 == 0).select(k.alias("file_id"), path(F.when(k % 7 == 0, k + 1).otherwise(k)), (F.col("o_custkey") + 1).alias("v"))
    return o.where(k % 5 != 0).select(k.alias("file_id"), path(k), F.col("o_custkey").alias("v")), rows


@query(f"with {_BASE} select * from b where file_id not in (select file_id from r) and rel_path not in (select rel_path from r) union all select * from r")
def base_upsert(spark, d):
    return state.upserted(*_base(spark, d))


@query(f"with {_BASE} select b.file_id, b.rel_path, coalesce(r.v, b.v) as v from b left join r on r.file_id = b.file_id")
def base_refresh(spark, d):
    return state.refreshed(*_base(spark, d), "v")


@query(f"with {_BASE} select rel_path, file_id from r where file_id not in (select file_id from b)")
def mirror_covers_base(spark, d):
    base, rows = _base(spark, d)
    return state.uncovered(rows, base)


@query("with p as (select p_partkey as k, p_size % 3 <> 0 as there, cast(p_size as bigint) as size, p_partkey % 10 as mt from part), f as (select p_partkey as k, cast(case when p_partkey % 6 = 0 then p_size + 1 else p_size end as bigint) as size, p_partkey % 10 as mt from part where p_partkey % 4 <> 0) select concat('f', cast(p.k as varchar)) as rel_path, case when there and f.k is null then 'vanished' when not there and f.k is not null then 'appeared' when there and (p.size <> f.size or p.mt <> f.mt) then 'changed' else 'ok' end as verdict from p left join f on f.k = p.k")
def presence_guard(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    path = F.concat(F.lit("f"), k.cast("string")).alias("rel_path")
    part = table(spark, d, "part")
    now = part.where(k % 4 != 0).select(path, F.when(k % 6 == 0, size + 1).otherwise(size).alias("size"), (k % 10).alias("mtime_ns"))
    return state.presence(part.select(path, (size % 3 != 0).alias("there"), size.alias("size"), (k % 10).alias("mtime_ns")), now)


@query("with a as (select p_partkey as k, p_size % 4 = 0 as dir, cast(p_size as bigint) as size from part where p_partkey % 5 <> 0), b as (select p_partkey as k, p_size % 4 = 0 or p_partkey % 17 = 0 as dir, cast(case when p_partkey % 6 = 0 then 0 else p_size end as bigint) as size from part where p_partkey % 7 <> 0) select * from (select concat('s/', cast(coalesce(a.k, b.k) as varchar)) as rel_path, case when a.k is null then 'appeared' when b.k is null then 'vanished' when a.dir <> b.dir or (not a.dir and a.size <> b.size) then 'changed' end as why from a full outer join b on a.k = b.k) t where why is not null")
def subtree_verification(spark, d):
    k, size, part = F.col("p_partkey"), F.col("p_size").cast("long"), table(spark, d, "part")
    path, mtime = F.concat(F.lit("s/"), k.cast("string")).alias("rel_path"), F.lit(1).alias("mtime_ns")
    a = part.where(k % 5 != 0).select(path, (size % 4 == 0).alias("is_dir"), size.alias("size"), mtime)
    b = part.where(k % 7 != 0).select(path, ((size % 4 == 0) | (k % 17 == 0)).alias("is_dir"), F.when(k % 6 == 0, F.lit(0).cast("long")).otherwise(size).alias("size"), mtime)
    return state.subtree_drift(a, b)


@query("select p, cast(n as int) as n, case when n = 1 then p else concat(left(p, length(p) - 4), ' (', cast(n as varchar), ').txt') end as name from (select concat(p_brand, '.txt') as p, row_number() over (partition by p_brand order by p_partkey) as n from part) t")
def rescue_names(spark, d):
    rows = table(spark, d, "part").select(F.concat("p_brand", F.lit(".txt")).alias("rel_path"), F.col("p_partkey").alias("order"))
    return state.rescue_names(rows).withColumnRenamed("rel_path", "p")


_FEED = """n as (select concat('n', cast(n_nationkey as varchar)) as file_id, concat('r', cast(n_regionkey as varchar)) as parent_id from nation where n_nationkey % 3 <> 0 union all select concat('r', cast(r_regionkey as varchar)), 'root' from region where r_regionkey <> 2),
c as (select c_custkey as seq, case when c_custkey % 4 = 0 then concat('n', cast(c_custkey % 25 as varchar)) else concat('x', cast(c_custkey % 90 as varchar)) end as file_id, case when c_custkey % 6 = 0 then 'root' else concat('r', cast(c_custkey % 5 as varchar)) end as parent_id, c_custkey % 9 = 0 as removed, c_custkey % 2 = 0 as is_dir from customer)"""


def _feed(spark, d):
    n, r, c, k = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer"), F.col("c_custkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    nodes = n.where("n_nationkey % 3 <> 0").select(name("n", F.col("n_nationkey")).alias("file_id"), name("r", F.col("n_regionkey")).alias("parent_id")).union(r.where("r_regionkey <> 2").select(name("r", F.col("r_regionkey")), F.lit("root")))
    ids = F.when(k % 4 == 0, name("n", k % 25)).otherwise(name("x", k % 90))
    return nodes, c.select(k.alias("seq"), ids.alias("file_id"), F.when(k % 6 == 0, "root").otherwise(name("r", k % 5)).alias("parent_id"), (k % 9 == 0).alias("removed"), (k % 2 == 0).alias("is_dir"))


@query(f"with {_FEED} select distinct file_id from c where is_dir and not removed and file_id not in (select file_id from n) and (parent_id = 'root' or parent_id in (select file_id from n))")
def feed_to_walk(spark, d):
    nodes, changes = _feed(spark, d)
    return state.to_walk(changes, nodes, "root")


@query(f"""with {_FEED}, l as (select * from (select *, row_number() over (partition by file_id order by seq desc) as k from c) t where k = 1),
s as (select concat('s', cast(s_suppkey as varchar)) as file_id, concat('x', cast(s_suppkey % 90 as varchar)) as parent_id from supplier union all select 'n1', 'read')
select file_id, parent_id from n where file_id not in (select file_id from l) and file_id not in (select file_id from s) union all select file_id, parent_id from l where not removed union all select * from s where file_id not in (select file_id from l)""")
def feed_backfill(spark, d):
    nodes, changes = _feed(spark, d)
    read = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file_id"), F.concat(F.lit("x"), (F.col("s_suppkey") % 90).cast("string")).alias("parent_id"))
    return state.backfilled(nodes, changes, read.union(spark.createDataFrame([("n1", "read")], read.schema)))


@query("with a as (select p_brand as b, p_size as s from part where p_partkey % 5 <> 0), b as (select p_brand, p_size from part where p_partkey % 7 <> 0) select *, 'a' as side from (select * from a except all select * from b) x union all select *, 'b' from (select * from b except all select * from a) y")
def tree_difference(spark, d):
    rows, k = table(spark, d, "part").select(F.col("p_brand").alias("b"), F.col("p_size").alias("s"), "p_partkey"), F.col("p_partkey")
    return state.differing(rows.where(k % 5 != 0).drop("p_partkey"), rows.where(k % 7 != 0).drop("p_partkey"))


@query("select o_orderkey, o_orderkey % 600 as code, (o_orderkey % 600 = 429 or o_orderkey % 600 between 500 and 599 or (o_orderkey % 600 = 403 and o_custkey % 2 = 0)) as again from orders where o_orderkey % 600 > 390")
def retryable_errors(spark, d):
    o = table(spark, d, "orders").withColumn("code", F.col("o_orderkey") % 600).where("code > 390")
    reasons = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("x"), F.lit("rateLimitExceeded"))).otherwise(F.array(F.lit("forbidden")))
    return o.select("o_orderkey", "code", state.retryable(F.col("code"), reasons).alias("again"))


@query("select count(*) as actions, cast(count(*) filter (where l_returnflag = 'N') as bigint) as executed, cast(count(*) filter (where l_returnflag = 'A') as bigint) as failed, max(l_orderkey + l_linenumber) - min(l_orderkey) as duration_ms from lineitem")
def cycle_summary(spark, d):
    flag = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select(F.when(flag == "N", "done").when(flag == "A", "failed").otherwise("planned").alias("status"), F.col("l_orderkey").alias("started_ms"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("ended_ms"))
    return status.cycle(rows)


@query("select c_custkey, case when c_custkey % 5 < 2 then '' else concat(' — ', cast(c_custkey as varchar), ' actions, ', cast(c_custkey - 1 as varchar), ' ok, ', case when c_custkey % 5 = 2 then '0' else '1' end, ' failed, ', cast(c_custkey * 3 as varchar), 'ms') end as suffix from customer")
def cycle_suffixes(spark, d):
    k = F.col("c_custkey")
    whole = F.concat(F.lit('{"actions":'), k.cast("string"), F.lit(',"executed":'), (k - 1).cast("string"), F.when(k % 5 == 2, "").otherwise(',"failed":1'), F.lit(',"duration_ms":'), (k * 3).cast("string"), F.lit("}"))
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, "{not json").otherwise(whole)
    return table(spark, d, "customer").select("c_custkey", status.cycle_suffix(text).alias("suffix"))


_DUR = "case when {s} < 60 then concat(cast({s} as varchar), 's') when {s} < 3600 then concat(cast({s} // 60 as varchar), 'm') when {s} < 86400 then concat(cast({s} // 3600 as varchar), 'h', cast({s} % 3600 // 60 as varchar), 'm') else concat(cast({s} // 86400 as varchar), 'd', cast({s} % 86400 // 3600 as varchar), 'h') end"


@query(f"select o_orderkey, case when o_orderkey % 9 = 0 then 'never' else concat({_DUR.replace('{s}', '(o_orderkey % 97 * 991)')}, ' ago') end as ago, case when o_orderkey % 9 = 0 then 'unknown' when o_orderkey % 97 * 991 = 0 or o_orderkey % 4 = 0 then 'now' else concat('in ', {_DUR.replace('{s}', '(o_orderkey % 97 * 991)')}) end as until from orders")
def relative_times(spark, d):
    k, now = F.col("o_orderkey"), F.lit(1_000_000).cast("long")
    gap = k % 97 * 991
    at = lambda t: F.when(k % 9 == 0, F.lit(0).cast("long")).otherwise(t)
    return table(spark, d, "orders").select("o_orderkey", status.ago(now, at(now - gap)).alias("ago"), status.until(now, at(F.when(k % 4 == 0, now - gap).otherwise(now + gap))).alias("until"))


@query("""select c_custkey, concat_ws('|', case when c_custkey % 11 = 0 then 'guard blocked: why' end, case when c_custkey % 13 = 0 then 'credentials expired' end, case when c_custkey % 7 = 0 then 'last error: bad' end, case when c_custkey % 3 = 0 then 'no system bin' end,
case when c_custkey % 4 = 0 then 'no heartbeats' when c_custkey % 4 < 3 then 'nothing is syncing' end, case when c_custkey % 17 = 0 then 'no saved credentials' end, case when c_custkey % 2 = 0 then 'autostart not installed' end) as told from customer""")
def attention_list(spark, d):
    k = F.col("c_custkey")
    state_ = F.when(k % 4 == 0, "stale").when(k % 4 == 1, "stopped").when(k % 4 == 2, "never-run").otherwise("running")
    told = status.attention(state_, F.when(k % 11 == 0, "why").otherwise(""), k % 13 == 0, F.when(k % 7 == 0, "bad").otherwise(""), k % 3 != 0, k % 17 != 0, k % 2 != 0)
    return table(spark, d, "customer").select("c_custkey", F.array_join(told, "|").alias("told"))


@query("""with a as (select event_id, case when event_type = 'error' then '' else concat('p/', cast(user_id as varchar)) end as p, case when event_id % 3 = 0 then '' else event_type end as dt, event_id % 5 * 700 as n, case event_type when 'click' then 'local' when 'view' then 'remote' when 'signup' then 'conflict' else '' end as s from events),
t as (select *, case when p = '' then dt when dt = '' then p else concat(p, ' ', dt) end as x from a)
select event_id, case s when 'local' then '↑' when 'remote' then '↓' when 'conflict' then '⇅' else '!' end as glyph, case when n <= 1 then x when p = '' then concat('×', format('{:,}', n), ' ', x) else concat(x, ' ×', format('{:,}', n)) end as line from t""")
def activity_lines(spark, d):
    t, k = F.col("event_type"), F.col("event_id")
    path = F.when(t == "error", "").otherwise(F.concat(F.lit("p/"), F.col("user_id").cast("string")))
    side = F.when(t == "click", "local").when(t == "view", "remote").when(t == "signup", "conflict").otherwise("")
    return table(spark, d, "events").select("event_id", status.glyph(side).alias("glyph"), status.activity_text(path, F.when(k % 3 == 0, "").otherwise(t), k % 5 * 700).alias("line"))


@query("""with n as (select p_partkey, case p_partkey % 4 when 0 then 'a' when 1 then 'A' when 2 then 'é' else concat('e', chr(769)) end as nm, case when p_partkey % 4 < 2 then 'a' else 'é' end as f from part)
select p_partkey, case when nfc_normalize(nm) <> nfc_normalize(f) then 'case' when lower(nm) <> lower(f) then 'normalization' else 'either' end as cause from n""")
def collision_causes(spark, d):
    k = F.col("p_partkey") % 4
    name, first = F.when(k == 0, "a").when(k == 1, "A").when(k == 2, "\u00e9").otherwise("e\u0301"), F.when(k < 2, "a").otherwise("\u00e9")
    key = lambda c, case, norm: P.fold_key(c, case, norm)
    return table(spark, d, "part").select("p_partkey", status.collision_cause(key(name, False, True), key(first, False, True), key(name, True, False), key(first, True, False), True, True).alias("cause"))


@query("select p_partkey, concat('[Trash Info]', chr(10), 'Path=/home/', replace(replace(p_name, '%', '%25'), ' ', '%20'), '/a%3Fb%C3%A9~$&+:=@%2A.txt', chr(10), 'DeletionDate=2026-07-08T10:30:00', chr(10)) as body from part")
def trash_infos(spark, d):
    return table(spark, d, "part").select("p_partkey", status.trash_info(F.concat(F.lit("/home/"), "p_name", F.lit("/a?bé~$&+:=@*.txt")), F.expr(NOW)).alias("body"))


@query("select cast(count(*) as bigint) as files, cast(sum(p_size) as bigint) as bytes from part where p_brand = 'Brand#11'")
def quarantine_usage(spark, d):
    return status.usage(table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_name").alias("rel_path"), F.col("p_size").cast("long").alias("size")), "Brand#11")


@query("select concat(p_brand, '/.trellis.tmp.', cast(p_partkey as varchar)) as rel_path from part where p_partkey % 6 = 0")
def temp_orphans(spark, d):
    k = F.col("p_partkey")
    name = F.concat("p_brand", F.when(k % 6 == 0, "/.trellis.tmp.").when(k % 6 == 1, "/.trellis.tmp./").otherwise("/x.trellis.tmp."), k.cast("string"))
    return status.orphans(table(spark, d, "part").select(name.alias("rel_path")))


@query("select event_id, event_type from events order by event_id desc limit 15 offset 30")
def activity_page(spark, d):
    return status.page(table(spark, d, "events").select("event_id", "event_type"), [F.col("event_id").desc()], 30, 15)


@query("""select concat('{"event_id":', cast(event_id as varchar), ',"event_type":"', event_type, '","user_id":', cast(user_id as varchar), '}') as json from events""")
def activity_json(spark, d):
    return status.as_json(table(spark, d, "events"), "event_id", "event_type", "user_id")
