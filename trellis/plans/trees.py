"""Trees of files and directories derived from orders, with renamed, deleted and clashing directories; run in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.sources.tables import table

TREES = """
src as (
  select o_orderkey as k, cast(o_custkey % 20 as int) as a, cast(o_orderkey % 5 as int) as e,
         concat('d', cast(o_custkey % 20 as varchar(20)), '/e', cast(o_orderkey % 5 as varchar(20))) as dir,
         concat('o', cast(o_orderkey as varchar(20)), '.txt') as nm,
         md5(concat(cast(o_orderkey as varchar(20)), '|', o_orderstatus, '|', o_orderpriority)) as h, cast(length(o_orderpriority) + o_orderkey % 97 as bigint) as sz
  from {orders}),
dirs as (
  select distinct a, -1 as e, concat('d', cast(a as varchar(20))) as dir, concat('D', cast(a as varchar(20))) as file_id from src
  union all select distinct a, e, dir, concat('E', cast(a as varchar(20)), '_', cast(e as varchar(20))) from src),
extra as (select * from (values ('moved', true, false), ('newdir', true, false), ('both', true, true), ('tc2', true, false), ('tc', false, true), ('rnew', false, true), ('rmoved', false, true), ('d5/z2', true, false), ('d5/z2/sub', true, false)) t(dir, here, there)),
base as (
  select concat('id', cast(k as varchar(20))) as file_id, concat(dir, '/', nm) as rel_path, false as is_dir, sz as size, h as md5, cast(1000 as bigint) as mtime_ns, h as drive_md5, cast(1 as bigint) as version
  from src where k % 20 <> 19 and k % 23 <> 22
  union all select file_id, dir, true, cast(0 as bigint), '', cast(1000 as bigint), '', cast(1 as bigint) from dirs),
loc as (
  select concat(case when k % 13 = 0 and a <> 9 and not (a = 5 and e = 2) then 'moved' when a = 5 and e = 2 then 'd5/z2' else dir end, '/', case when k % 20 = 19 and k % 3 = 0 then upper(nm) else nm end) as rel_path,
         k % 97 = 1 as is_dir, case when k % 97 = 1 then cast(0 as bigint) else sz end as size, cast(case when k % 9 = 0 then 2000 else 1000 end as bigint) as mtime_ns,
         case when k % 97 = 1 then '' when k % 7 = 0 and a <> 9 then md5(concat(h, case when k % 2 = 0 then 'B' else 'L' end)) else h end as md5
  from src where k % 11 <> 0 and k % 20 <> 18 and a not in (7, 11) and not (a = 9 and (k % 20 = 19 or k % 23 = 22))
  union all select dir, true, cast(0 as bigint), cast(1000 as bigint), '' from dirs where a not in (7, 11) and not (a = 5 and e = 2)
  union all select dir, true, cast(0 as bigint), cast(1000 as bigint), '' from extra where here
  union all select 'tc', false, cast(3 as bigint), cast(1000 as bigint), 'tc'),
rem as (
  select concat(case when k % 23 = 22 then 'new' else 'id' end, cast(k as varchar(20))) as file_id,
         concat(case when k % 17 = 0 and a <> 7 then 'rmoved' when a = 3 then concat('rd3/e', cast(e as varchar(20))) else dir end, '/', nm) as rel_path, false as is_dir, sz as size,
         case when k % 6 = 0 and a <> 7 then md5(concat(h, case when k % 2 = 0 then 'B' else 'R' end)) else h end as md5,
         cast(case when k % 8 = 0 then 2 else 1 end as bigint) as version, cast(case when k % 10 = 9 then 1500 else 0 end as bigint) as modified_ns
  from src where k % 19 <> 0 and a not in (9, 11) and not (a = 7 and (k % 20 = 19 or k % 23 = 22))
  union all select file_id, case when a = 3 and e < 0 then 'rd3' when a = 3 then concat('rd3/e', cast(e as varchar(20))) else dir end, true, cast(0 as bigint), '', cast(1 as bigint), cast(0 as bigint) from dirs where a not in (9, 11)
  union all select concat('X', dir), dir, true, cast(0 as bigint), '', cast(1 as bigint), cast(0 as bigint) from extra where there
  union all select 'Xtc2', 'tc2', false, cast(4 as bigint), 'tc2', cast(1 as bigint), cast(0 as bigint)),
shad as (select concat('id', cast(k as varchar(20))) as file_id from src where k % 41 = 0 union all select 'D13'),
unread as (select concat('id', cast(k as varchar(20))) as file_id from src where k % 43 = 0 or k % 41 = 0)"""


def trees(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    text = TREES.replace("{orders}", "{o}")
    return {name: spark.sql(f"with {text} select * from {name}", o=orders) for name in ("base", "loc", "rem", "shad", "unread")}


def _moved(path: str, moves: str) -> str:
    return f"coalesce((select arg_max(concat(m.t, substr({path}, length(m.f) + 1)), length(m.f)) from {moves} m where starts_with({path}, concat(m.f, '/'))), {path})"


#: The path after moves, for other texts than the plan's.
moved_sql = _moved


def _copy(path: str) -> str:
    return f"concat(regexp_replace({path}, '\\.[^./]*$', ''), ' (conflict test_box 2026-07-08_103000)', regexp_extract({path}, '(\\.[^./]*)$', 1))"


def _act(kind: str, at: str, source: str, to: str = "null", fid: str = "null", by: str = "null", size: str = "null", mtime: str = "null", is_dir: str = "false") -> str:
    return f"select '{kind}' as type, {at} as rel_path, {to} as new_rel_path, {fid} as file_id, {is_dir} as is_dir, {by} as protected_by, {size} as pin_size, {mtime} as pin_mtime from {source}"


def _acts() -> str:
    l_pin, o_pin, pin = {"size": "ls", "mtime": "lt"}, {"size": "os", "mtime": "ot"}, {"size": "size", "mtime": "mtime_ns"}
    after, open_ = "case when mvd then ex end", "f3 where"
    return " union all ".join([
        _act("record", "go", f"{open_} met and om = rm", fid="file_id", **o_pin),
        _act("forget", "rel_path", f"{open_} not hl and not hr", fid="file_id"),
        _act("download", "go", f"{open_} not met and not hl and hr and (rc or mvd)", fid="file_id"),
        _act("record", '"at"', f"{open_} hl and not hr and lc and hn and nm = lm", fid="nid", **l_pin),
        _act("upload", '"at"', f"{open_} hl and not hr and lc and not hn"),
        _act("quarantine_local", '"at"', f"{open_} hl and not hr and not lc and not hn", fid="file_id", **l_pin),
        _act("record", "go", f"{open_} hl and hr and not lc and not rc and (mtime_ns <> lt or size <> ls or version <> rv)", fid="file_id", by=after, **l_pin),
        _act("update_remote", "go", f"{open_} hl and hr and lc and not rc", fid="file_id", by=after),
        _act("download", "go", f"{open_} hl and hr and not lc and rc", fid="file_id", **l_pin),
        _act("record", "go", f"{open_} hl and hr and lc and rc and lm = rm", fid="file_id", by=after, **l_pin),
        _act("conflict_backup", "spot", "tri", to=_copy("spot")), _act("upload", _copy("spot"), "tri", by="spot"), _act("download", "dst", "tri", fid="id", by="spot"),
        _act("conflict_backup", "go", f"{open_} moving and displaced", to=_copy("go")), _act("upload", _copy("go"), f"{open_} moving and displaced", by="go"),
        _act("move_local", "ex", f"{open_} moving and displaced", to="go", fid="file_id", by="go"),
        _act("move_local", "ex", f"{open_} moving and not displaced and ofile", to="go", fid="file_id", **o_pin),
        _act("move_local", "ex", f"{open_} moving and not ofile", to="go", fid="file_id"),
        _act("record", "tg", "n3 where is_dir and nid is not null and ndir", fid="nid", is_dir="true"),
        _act("mkdir_remote", "tg", "n3 where is_dir and nid is null and not taken", is_dir="true"),
        _act("record", "tg", "n3 where not is_dir and nid is not null and not ndir and nm = md5", fid="nid", **pin),
        _act("move_local", "tg", "n3 where not is_dir and nid is null and fid is not null and fm = md5", to="fp", **pin),
        _act("record", "fp", "n3 where not is_dir and nid is null and fid is not null and fm = md5", fid="fid", by="tg", **pin),
        _act("move_remote", "sp", "win", to=_copy("sp"), fid="id"), _act("upload", "tg", "win", by="sp"), _act("download", _copy("sp"), "win", fid="id", by="sp"),
        _act("move_remote", "pr.s", "pr", to="pr.tg", fid="pr.file_id"),
        _act("upload", "tg", "lone where rel_path not in (select d from pr)"),
    ])


def tree_sql(then: str) -> str:
    """The plan of the trees by theta joins and correlated lookups, for an engine on one machine; then reads final and skips."""
    anti = lambda c, of: f"{c} not in (select {c} from {of})"
    return f"""with {TREES.replace('{orders}', 'orders')},
rd as (select b.rel_path as f, r.rel_path as t from base b join rem r on r.file_id = b.file_id where b.is_dir and r.rel_path <> b.rel_path),
ev as (select b.*, {_moved('b.rel_path', 'rd')} as ex, l.md5 as lm, l.is_dir as ldir, l.rel_path is not null as hl, r.rel_path as rp, r.md5 as rm from base b join rem r on r.file_id = b.file_id left join loc l on l.rel_path = b.rel_path where not b.is_dir),
g0 as (select rel_path as p, md5, size, row_number() over (partition by md5, size order by rel_path) as k from ev where not hl and rm = drive_md5 and rp = ex),
a0 as (select rp as rel_path from ev where hl and not ldir and rp <> ex and not (lm <> md5 and rm <> drive_md5 and lm <> rm) union all select rel_path from rem where not is_dir and {anti('file_id', 'base')}),
n0 as (select rel_path as p, md5, size, row_number() over (partition by md5, size order by rel_path) as k from loc where not is_dir and {anti('rel_path', 'base')} and {anti('rel_path', 'a0')}),
p0 as (select g.p as s, n.p as d from g0 g join n0 n on g.md5 = n.md5 and g.size = n.size and g.k = n.k),
cd as (
  select f, file_id, min(cut) as t, count(distinct cut) as n, bool_and(ok) as ok from (
    select b.rel_path as f, b.file_id, substr(p.d, 1, length(p.d) - length(p.s) + length(b.rel_path)) as cut, ends_with(p.d, substr(p.s, length(b.rel_path) + 1)) and length(p.d) > length(p.s) - length(b.rel_path) as ok
    from base b join p0 p on starts_with(p.s, concat(b.rel_path, '/')) join rem r on r.file_id = b.file_id and r.rel_path = b.rel_path where b.is_dir and b.{anti('rel_path', 'loc')}) q group by f, file_id),
c1 as (select f, t, file_id from cd where ok and n = 1 and t in (select rel_path from loc where is_dir) and t not in (select rel_path from base) and t not in (select rel_path from rem)),
ld as (select * from c1 c where not exists (select 1 from c1 o where starts_with(c.f, concat(o.f, '/')))),
dl as (select t as f, f as t from ld), mv as (select f, t from rd union all select f, t from ld),
th as (select r.*, {_moved('r.rel_path', 'ld')} as tp from rem r), fr as (select * from th where {anti('file_id', 'base')}),
kn as (select b.*, coalesce(case when b.is_dir then (select x.t from ld x where x.f = b.rel_path) end, {_moved('b.rel_path', 'ld')}) as "at", {_moved('b.rel_path', 'mv')} as ex,
       case when b.file_id in (select file_id from shad) then 'remote copy is shadowed' when b.file_id in (select file_id from unread) then 'local copy can''t be read' end as why from base b),
kj as (select kn.*, l.rel_path is not null as hl, l.is_dir as ldir, l.size as ls, l.mtime_ns as lt, l.md5 as lm, r.file_id is not null as hr, r.rel_path as rp, r.tp, r.md5 as rm, r.version as rv,
       coalesce(r.tp, kn.ex) as go, coalesce(r.tp <> kn.ex, false) as mvd from kn left join loc l on l.rel_path = kn."at" left join th r on r.file_id = kn.file_id),
f1 as (select j.*, o.rel_path is not null and not o.is_dir as ofile, o.size as os, o.mtime_ns as ot, o.md5 as om, t.rel_path is not null as tracked, n.file_id is not null as hn, n.file_id as nid, n.md5 as nm,
       j.hl and j.lm <> j.md5 as lc, j.hr and j.rm <> j.drive_md5 as rc
       from kj j left join loc o on j.mvd and o.rel_path = j.go left join base t on j.mvd and t.rel_path = j.go left join fr n on j.hl and not j.hr and n.rel_path = j."at" where not j.is_dir and j.why is null and not (j.hl and j.ldir)),
f2 as (select *, not hl and mvd and not tracked and ofile as met, hl and hr and lc and rc and lm <> rm as clash, ofile and not tracked as displaced from f1),
f3 as (select *, mvd and hl and not clash as moving from f2),
n1 as (select l.*, {_moved('l.rel_path', 'mv')} as tg, coalesce((select x.t from dl x where x.f = l.rel_path), {_moved('l.rel_path', 'dl')}) as og from loc l
       where l.{anti('rel_path', 'base')} and l.rel_path not in (select go from f3 where met or (moving and displaced))),
n2 as (select * from n1 where og = rel_path or og not in (select rel_path from base)),
n3 as (select x.*, n.file_id as nid, n.is_dir as ndir, n.md5 as nm, n.modified_ns as nt, x.tg in (select rel_path from rem) as taken, f.file_id as fid, f.rel_path as fp, f.md5 as fm, f.modified_ns as ft
       from n2 x left join fr n on n.rel_path = x.tg left join (select * from fr where not is_dir) f on n.file_id is null and not x.is_dir and lower(f.rel_path) = lower(x.tg) and f.rel_path <> x.tg),
met as (select tg, nid as id, tg as sp, nm as m, nt as t, md5, mtime_ns from n3 where not is_dir and nid is not null and not ndir union all select tg, fid, fp, fm, ft, md5, mtime_ns from n3 where not is_dir and nid is null and fid is not null),
win as (select * from met where m <> md5 and t > 0 and mtime_ns > t),
tri as (select ex as spot, go as dst, file_id as id from f3 where clash union all select go, go, file_id from f3 where met and om <> rm union all select "at", "at", nid from f3 where hl and not hr and lc and hn and nm <> lm
        union all select tg, sp, id from met where m <> md5 and not (t > 0 and mtime_ns > t)),
gone as (select rel_path, file_id, md5, size, row_number() over (partition by md5, size order by rel_path) as k from f3 where not hl and hr and not rc and not mvd),
lone as (select rel_path, tg, md5, size, row_number() over (partition by md5, size order by rel_path) as k from n3 where not is_dir and nid is null and fid is null),
pr as (select g.rel_path as s, g.file_id, l.rel_path as d, l.tg from gone g join lone l on g.md5 = l.md5 and g.size = l.size and g.k = l.k),
a1 as ({_acts()}),
lf as (select r.*, l.rel_path is not null as hl, l.is_dir as ldir, l.size as ls, l.mtime_ns as lt, r.tp in (select rel_path from a1 where type in ('move_local', 'conflict_backup')) as gone from fr r left join loc l on l.rel_path = r.tp
       where r.rel_path not in (select nid2 from (select "at" as nid2 from f3 where hn and lc and not hr union all select tg from n3 where nid is not null union all select fp from n3 where nid is null and fid is not null) q)),
a2 as (select * from a1 union all {_act('mkdir_local', 'tp', 'lf where is_dir and not (hl and not ldir)', fid='file_id', is_dir='true')}
       union all {_act('download', 'tp', 'lf where not is_dir and not (hl and ldir)', fid='file_id', size='case when hl and not gone then ls end', mtime='case when hl and not gone then lt end')}
       union all {_act('move_local', 's', f"(select {_moved('rd.f', 'mv')} as s, rd.t from rd) q where s <> t", to='t', is_dir='true')} union all {_act('move_remote', 'f', 'ld', to='t', fid='file_id', is_dir='true')}),
made as (select distinct case when type in ('move_remote', 'move_local', 'conflict_backup') then new_rel_path else rel_path end as p from a2 where type not in ('forget', 'quarantine_local', 'trash_remote')),
up as (select distinct array_to_string(list_slice(string_split(p, '/'), 1, i), '/') as dir from made, lateral (select unnest(range(1, len(string_split(p, '/')))) as i) u),
al as (select distinct array_to_string(list_slice(string_split(rel_path, '/'), 1, i), '/') as dir from fr, lateral (select unnest(range(1, len(string_split(rel_path, '/')))) as i) u),
dr as (select *, rel_path in (select dir from up) or ex in (select dir from up) as used, coalesce(rp in (select rel_path from loc where is_dir) or rp in (select dir from up) or tp in (select dir from up) or rp in (select dir from al), false) as live from kj where is_dir and why is null),
a3 as (select * from a2 union all {_act('trash_remote', 'rel_path', 'gone where rel_path not in (select s from pr)', fid='file_id')}
       union all {_act('mkdir_remote', 'rel_path', 'dr where hl and not hr and used', is_dir='true')} union all {_act('quarantine_local', '"at"', 'dr where hl and not hr and not used', fid='file_id', is_dir='true')}
       union all {_act('trash_remote', 'rp', 'dr where not hl and hr and not live', fid='file_id', is_dir='true')} union all {_act('forget', 'rel_path', 'dr where not hl and not hr', fid='file_id', is_dir='true')}),
final as (select case when type = 'move_local' and is_dir then 1 when type = 'mkdir_remote' and exists (select 1 from ld where a3.rel_path = ld.t or starts_with(a3.rel_path, concat(ld.t, '/'))) then 4 when type in ('mkdir_remote', 'mkdir_local') then 2
          when type = 'move_remote' and is_dir then 3 when type in ('move_local', 'move_remote', 'conflict_backup') then 5 when type in ('upload', 'update_remote', 'download', 'record') then 6 else 7 end as stage, * from a3),
skips as (select rel_path, why as reason from kj where why is not null union all select rel_path, 'a directory took the place of the file' from kj where not is_dir and why is null and hl and ldir
          union all select tg, 'a file on one side, a directory on the other' from n3 where nid is not null and is_dir <> ndir union all select tp, 'a file on one side, a directory on the other' from lf where hl and ldir <> is_dir)
{then}"""


ORDERED = """select *, row_number() over (order by stage, type <> 'conflict_backup', case when stage = 7 then -1 when stage = 6 then 0 else 1 end * (length(rel_path) - length(replace(rel_path, '/', ''))),
case when stage <> 7 then rel_path end nulls first, case when stage = 7 then rel_path end desc nulls last, type, new_rel_path nulls first, file_id nulls first) as ord from final"""
COLLAPSED = """, roots0 as (select rel_path as r, type as k from final f where is_dir and type in ('quarantine_local', 'trash_remote')
  and not exists (select 1 from final b where b.type not in ('quarantine_local', 'trash_remote', 'forget') and (starts_with(b.rel_path, concat(f.rel_path, '/')) or starts_with(b.new_rel_path, concat(f.rel_path, '/'))))
  and (type <> 'trash_remote' or not exists (select 1 from rem x where starts_with(x.rel_path, concat(f.rel_path, '/')) and x.rel_path not in (select rel_path from final where type in ('trash_remote', 'forget'))))),
roots as (select * from roots0 a where not exists (select 1 from roots0 b where starts_with(a.r, concat(b.r, '/')))),
cov as (select f.type, f.rel_path, f.is_dir, r.r from final f join roots r on r.k = f.type and starts_with(f.rel_path, concat(r.r, '/')))
select f.stage, f.type, f.rel_path, f.is_dir, cast(coalesce((select count(*) from cov c where c.r = f.rel_path and f.is_dir and c.type = f.type and not c.is_dir), 0) as bigint) as subtree_files,
       cast(coalesce((select count(*) from cov c where c.r = f.rel_path and f.is_dir and c.type = f.type), 0) as bigint) as entries
from final f where not exists (select 1 from cov c where c.type = f.type and c.rel_path = f.rel_path)"""
