"""The SQL counterpart of each query, for a check in another engine (DuckDB syntax)."""

from __future__ import annotations

import re

from sparkwalk.fixtures import ctes

VE = """ve as (
  select v.variant, e.id, e.src_vid, e.trg_vid, e.len_mm len, e.exists_, e.is_xwalk
  from net_edges e join (values ('current'), ('sidewalks'), ('crosswalks'), ('both')) v(variant)
  on v.variant = 'both' or e.exists_ or (v.variant = 'sidewalks' and not e.is_xwalk) or (v.variant = 'crosswalks' and e.is_xwalk)
)"""
ARCS = """arcs as (
  select variant, src_vid u, trg_vid w, id, len from ve union all select variant, trg_vid, src_vid, id, len from ve
)"""
CC = """cc(variant, vid, cid) using key (variant, vid) as (
  select distinct variant, u, u from arcs
  union
  (select a.variant, a.w, min(c.cid) from cc c join arcs a on a.variant = c.variant and a.u = c.vid
   join recurring.cc r on r.variant = a.variant and r.vid = a.w where c.cid < r.cid group by 1, 2)
)"""
PAIRS = """pairs as (
  select a.variant, o.vid_o, o.vid_d, cast(sum(o.n_ods) as bigint) n_ods
  from od o join cc a on a.vid = o.vid_o join cc b on b.vid = o.vid_d and b.variant = a.variant
  where a.cid = b.cid group by 1, 2, 3
)"""
SP = """sp(variant, o, v, d) using key (variant, o, v) as (
  select distinct variant, vid_o, vid_o, cast(0 as bigint) from pairs
  union
  (select s.variant, s.o, a.w, min(s.d + a.len) from sp s join arcs a on a.variant = s.variant and a.u = s.v
   left join recurring.sp r on r.variant = s.variant and r.o = s.o and r.v = a.w
   where r.d is null or s.d + a.len < r.d group by 1, 2, 3)
)"""
# The same in two parts: all origins as far as NEAR millimetres, and those with a destination beyond it to the end.
NEAR = 2_500_000
SP_FAR = f"""near(variant, o, v, d) using key (variant, o, v) as (
  select distinct variant, vid_o, vid_o, cast(0 as bigint) from pairs
  union
  (select s.variant, s.o, a.w, min(s.d + a.len) from near s join arcs a on a.variant = s.variant and a.u = s.v and s.d + a.len <= {NEAR}
   left join recurring.near r on r.variant = s.variant and r.o = s.o and r.v = a.w
   where r.d is null or s.d + a.len < r.d group by 1, 2, 3)
),
late as (
  select distinct p.variant, p.vid_o from pairs p left join near n on n.variant = p.variant and n.o = p.vid_o and n.v = p.vid_d where n.d is null
),
far(variant, o, v, d) using key (variant, o, v) as (
  select variant, vid_o, vid_o, cast(0 as bigint) from late
  union
  (select s.variant, s.o, a.w, min(s.d + a.len) from far s join arcs a on a.variant = s.variant and a.u = s.v
   left join recurring.far r on r.variant = s.variant and r.o = s.o and r.v = a.w
   where r.d is null or s.d + a.len < r.d group by 1, 2, 3)
),
sp as (
  select * from far union all
  select n.* from near n left join late l on l.variant = n.variant and l.vid_o = n.o where l.vid_o is null
)"""
PRED = """pred as (
  select s.variant, s.o, a.w v, min({'id': a.id, 'p': a.u}) b
  from sp s join arcs a on a.variant = s.variant and a.u = s.v
  join sp t on t.variant = s.variant and t.o = s.o and t.v = a.w and t.d = s.d + a.len
  where a.w <> s.o group by 1, 2, 3
)"""
WALK = """walk(variant, vid_o, vid_d, n_ods, edge_id, p, hop) as (
  select q.variant, q.vid_o, q.vid_d, q.n_ods, t.b.id, t.b.p, 0 from pairs q
  join pred t on t.variant = q.variant and t.o = q.vid_o and t.v = q.vid_d where q.vid_o <> q.vid_d
  union all
  select k.variant, k.vid_o, k.vid_d, k.n_ods, t.b.id, t.b.p, k.hop + 1 from walk k
  join pred t on t.variant = k.variant and t.o = k.vid_o and t.v = k.p where k.p <> k.vid_o
)"""
# one variant only
VE_CURRENT = """ve as (select 'current' variant, id, src_vid, trg_vid, len_mm len, exists_, is_xwalk from net_edges where exists_)"""
BETWEEN = """src as (select distinct variant, u vid_o from arcs),
sp(variant, o, v, d) using key (variant, o, v) as (
  select variant, vid_o, vid_o, cast(0 as bigint) from src
  union
  (select s.variant, s.o, a.w, min(s.d + a.len) from sp s join arcs a on a.variant = s.variant and a.u = s.v
   left join recurring.sp r on r.variant = s.variant and r.o = s.o and r.v = a.w
   where r.d is null or s.d + a.len < r.d group by 1, 2, 3)
),
dag as materialized (
  select s.o, a.u, a.w, a.id from sp s join arcs a on a.u = s.v join sp t on t.o = s.o and t.v = a.w and t.d = s.d + a.len
),
fwd(k, o, v, s) as (
  select 0, vid_o, vid_o, cast(1 as double) from src
  union all
  (select k + 1, f.o, g.w, sum(f.s) from fwd f join dag g on g.o = f.o and g.u = f.v group by 1, 2, 3)
),
sigma as (select o, v, sum(s) s from fwd group by 1, 2),
share as materialized (select g.o, g.u, g.w, g.id, a.s / b.s share from dag g join sigma a on a.o = g.o and a.v = g.u join sigma b on b.o = g.o and b.v = g.w),
back(k, o, v, x) as (
  select 0, o, v, cast(1 as double) from sp where o <> v
  union all
  (select k + 1, b.o, g.u, sum(b.x * g.share) from back b join share g on g.o = b.o and g.w = b.v group by 1, 2, 3)
),
arrived as (select o, v, sum(x) x from back group by 1, 2),
bw as (select g.id, sum(a.x * g.share) / 2 bwness from arrived a join share g on g.o = a.o and g.w = a.v group by 1)"""

SCORED = """scored as (select id, src_vid, trg_vid, len_mm len, exists_, is_xwalk, cast(id * 37 % 101 as double) pedscore from net_edges),
setting as (select greatest((select count(*) from part) // 14, 1) step_size),
best as (
  select s.*, row_number() over (order by pedscore desc, id) rnk, row_number() over (order by pedscore, id) rnk_worst
  from scored s where is_xwalk and not exists_
),
n_new as (select count(*) n from best)"""
# components and distances keyed by step
TRIPS_STEPS = """steps as (select unnest(range(0, (select n // step_size + 1 from n_new, setting))) step union all select 1000000),
ve as (
  select st.step variant, s.src_vid, s.trg_vid from scored s join steps st on s.exists_
  union all
  select st.step, b.src_vid, b.trg_vid from best b join steps st on b.rnk <= st.step * (select step_size from setting)
),
arcs as (select variant, src_vid u, trg_vid w from ve union all select variant, trg_vid, src_vid from ve)"""
TRIPS_CURVE = """per_step as (
  select a.variant step, cast(sum(o.n_ods) as bigint) n_trips
  from od o join cc a on a.vid = o.vid_o join cc b on b.vid = o.vid_d and b.variant = a.variant where a.cid = b.cid group by 1
),
low as (select n_trips from per_step where step = 0), high as (select n_trips from per_step where step = 1000000),
curve as (
  select cast(p.step * step_size as int) n_links, case when p.step = 0 then 0.0 else 100.0 * p.step * step_size / n end pct_links,
    case when p.step = 0 then 0.0 else 100.0 * (p.n_trips - low.n_trips) / (high.n_trips - low.n_trips) end pct_new_trips,
    cast(coalesce((select sum(b.len) from best b where b.rnk <= p.step * step_size), 0) as bigint) length, p.n_trips
  from per_step p, setting, n_new, low, high where p.step < 1000000
)"""
DIST_STEPS = """base_arcs as (
  select src_vid u, trg_vid w from scored where exists_ union all select trg_vid, src_vid from scored where exists_
),
base_cc(variant, vid, cid) using key (variant, vid) as (
  select distinct 0, u, u from base_arcs
  union
  (select 0, a.w, min(c.cid) from base_cc c join base_arcs a on a.u = c.vid
   join recurring.base_cc r on r.vid = a.w where c.cid < r.cid group by 2)
),
base_pairs as (
  select o.vid_o, o.vid_d, cast(sum(o.n_ods) as bigint) n_ods from od o
  join base_cc a on a.vid = o.vid_o join base_cc b on b.vid = o.vid_d where a.cid = b.cid group by 1, 2
),
dsteps as (select unnest(range(0, cast((select ceil(n / step_size) + 1 from n_new, setting) as bigint))) step),
ve as (
  select st.step variant, s.id, s.src_vid, s.trg_vid, s.len from scored s join dsteps st on s.exists_
  union all
  select st.step, b.id, b.src_vid, b.trg_vid, b.len from best b join dsteps st on b.rnk_worst > st.step * (select step_size from setting)
),
arcs as (select variant, src_vid u, trg_vid w, id, len from ve union all select variant, trg_vid, src_vid, id, len from ve),
pairs as (select st.step variant, p.* from base_pairs p join dsteps st on true),
sp(variant, o, v, d) using key (variant, o, v) as (
  select distinct variant, vid_o, vid_o, cast(0 as bigint) from pairs
  union
  (select s.variant, s.o, a.w, min(s.d + a.len) from sp s join arcs a on a.variant = s.variant and a.u = s.v
   left join recurring.sp r on r.variant = s.variant and r.o = s.o and r.v = a.w
   where r.d is null or s.d + a.len < r.d group by 1, 2, 3)
),
step_dist as (
  select p.variant step, p.vid_o, p.vid_d, p.n_ods, s.d from pairs p join sp s on s.variant = p.variant and s.o = p.vid_o and s.v = p.vid_d
)"""
DIST_CURVE = """means as (select step, avg(d) d_mean from step_dist group by 1),
mean_curve as (
  select cast(m.step as int) step, cast(((select max(step) from means) - m.step) * step_size as int) n_links,
    cast(greatest(n - m.step * step_size, 0) as int) n_left, d_mean,
    (1 - (d_mean - min(d_mean) over ()) / (max(d_mean) over () - min(d_mean) over ())) * 100 delta_mean
  from means m, setting, n_new
)"""
# nulls filled by row position: last known and next known rows
FILL = """filled_{c} as (
  select *, case when a_{c} is null or pa_{c} = pb_{c} then b_{c} else b_{c} + (a_{c} - b_{c}) / (pa_{c} - pb_{c}) * (pos - pb_{c}) end f_{c}
  from (
    select *, last_value({c} ignore nulls) over (order by pos) b_{c},
      last_value(case when {c} is not null then pos end ignore nulls) over (order by pos) pb_{c},
      first_value({c} ignore nulls) over (order by pos rows between current row and unbounded following) a_{c},
      first_value(case when {c} is not null then pos end ignore nulls) over (order by pos rows between current row and unbounded following) pa_{c}
    from {t}
  )
)"""
SPOTS = """spots as (
  select c_custkey odpt_id, cast(c_custkey * 7919 % 1999993 as double) x,
    cast(c_custkey * 104729 % ((select count(*) from part) * 5000 - 7) as double) y,
    cast(case when c_acctbal > 0 then round(c_acctbal * 100) else 0 end as bigint) weight
  from customer
)"""
SHOPS = """shops as (
  select s_suppkey odpt_id, cast(s_suppkey * 15485863 % 1999993 as double) x,
    cast(s_suppkey * 32452843 % ((select count(*) from part) * 5000 - 7) as double) y
  from supplier
)"""
LINES = """lines as (
  select e.id eid, e.src_vid, e.trg_vid, cast(a.x_mm as double) x1, cast(a.y_mm as double) y1, cast(b.x_mm as double) x2, cast(b.y_mm as double) y2,
    sqrt(cast((b.x_mm - a.x_mm) * (b.x_mm - a.x_mm) + (b.y_mm - a.y_mm) * (b.y_mm - a.y_mm) as double)) len
  from net_edges e join net_nodes a on a.vid = e.src_vid join net_nodes b on b.vid = e.trg_vid
)"""


def _piece(px: str, py: str, s: str) -> str:
    """Distance from a point to a straight piece of table ``s``."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    t = f"coalesce(least(greatest((({px} - {s}.x1) * {dx} + ({py} - {s}.y1) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0.0), 1.0), 0.0)"
    ex, ey = f"({px} - ({s}.x1 + {t} * {dx}))", f"({py} - ({s}.y1 + {t} * {dy}))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


STREETS = """ends as (select id road_id, x1 x, y1 y from street_roads union all select id, x2, y2 from street_roads),
ixns as (
  select cast(row_number() over (order by x, y) - 1 as int) ixn_id, x, y from (select x, y from ends group by 1, 2 having count(*) > 1)
)"""
CANDIDATES = STREETS + f""",
ixn_road as (select distinct ixn_id, road_id from ixns join ends using (x, y)),
sw_ixn as (select distinct s.id sw_id, i.ixn_id from street_sidewalks s join ixns i on {_piece("i.x", "i.y", "s")} <= 20),
sw_pt as (
  select id sw_id, x1 x, y1 y from street_sidewalks where id in (select sw_id from sw_ixn)
  union select id, x2, y2 from street_sidewalks where id in (select sw_id from sw_ixn)
),
pt_ixn as (select distinct p.x, p.y, i.ixn_id ixn_uid from sw_pt p join ixns i on sqrt((p.x-i.x)*(p.x-i.x) + (p.y-i.y)*(p.y-i.y)) <= 20),
sw_road as (select distinct sw_id, road_id from sw_ixn join ixn_road using (ixn_id)),
mean as (
  select k.sw_id, k.road_id, round(avg({_piece("p.x", "p.y", "r")}), 9) m
  from sw_road k join sw_pt p using (sw_id) join street_roads r on r.id = k.road_id group by 1, 2
),
own as (select sw_id, road_id from (select *, row_number() over (partition by sw_id order by m, road_id) rn from mean) where rn = 1),
roles as (
  select p.x, p.y, p.sw_id, s.ixn_id, w.road_id, t.ixn_uid from sw_pt p join sw_ixn s using (sw_id) join own w using (sw_id)
  join ixn_road r on r.ixn_id = s.ixn_id and r.road_id = w.road_id join pt_ixn t on t.x = p.x and t.y = p.y
),
known as (
  select least({{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}) f, greatest({{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}) t from street_crosswalks
),
both_ends as (
  select a.ixn_id, a.road_id, a.x x1, a.y y1, b.x x2, b.y y2, a.sw_id sw_id_x, b.sw_id sw_id_y, a.ixn_uid,
    sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) len
  from roles a join roles b on a.ixn_id = b.ixn_id and a.ixn_uid = b.ixn_uid and a.road_id = b.road_id and a.sw_id <> b.sw_id
    and (a.x < b.x or (a.x = b.x and a.y < b.y))
),
crossing as (
  select c.* from both_ends c join street_roads r on r.id = c.road_id
  where sign((c.x2-c.x1)*(r.y1-c.y1) - (c.y2-c.y1)*(r.x1-c.x1)) * sign((c.x2-c.x1)*(r.y2-c.y1) - (c.y2-c.y1)*(r.x2-c.x1)) <= 0
    and sign((r.x2-r.x1)*(c.y1-r.y1) - (r.y2-r.y1)*(c.x1-r.x1)) * sign((r.x2-r.x1)*(c.y2-r.y1) - (r.y2-r.y1)*(c.x2-r.x1)) < 0
    and not exists (select 1 from known k where k.f = {{'x': c.x1, 'y': c.y1}} and k.t = {{'x': c.x2, 'y': c.y2}})
)"""


def _candidate(own: str) -> str:
    return f"""with {ctes("street_roads", "street_sidewalks", "street_crosswalks")},
{CANDIDATES}
select ixn_id, road_id, round(len, 6) len, sw_id_x, sw_id_y, x1, y1, x2, y2
from (select *, row_number() over (partition by ixn_id, road_id order by len, x1, y1, x2, y2, sw_id_x, sw_id_y) rn from crossing {own})
where rn = 1"""


NEAREST_STOP = f"""near as (
  select s.odpt_id, s.x, s.y, min({{'d': {_piece("s.x", "s.y", "l")}, 'eid': l.eid}}) b from spots s join lines l on true group by all
),
taken as (select distinct b.eid eid from near),
cuts as (
  select l.*, unnest(list_distinct(list_append([i * 5000.0e0 for i in range(0, cast(floor(l.len / 5000.0e0) as bigint) + 1)], l.len))) pos
  from lines l join taken using (eid)
),
stops as (
  select eid, pos, len, src_vid, trg_vid, x1 + least(pos / len, 1.0) * (x2 - x1) px, y1 + least(pos / len, 1.0) * (y2 - y1) py from cuts
),
entry as (
  select n.odpt_id, n.b.d d, min({{'d': sqrt((n.x-t.px)*(n.x-t.px) + (n.y-t.py)*(n.y-t.py)), 'eid': t.eid, 'pos': t.pos, 'len': t.len, 'a': t.src_vid, 'b': t.trg_vid}}) s
  from near n join stops t on t.px between n.x - n.b.d - 10000 and n.x + n.b.d + 10000 and t.py between n.y - n.b.d - 10000 and n.y + n.b.d + 10000
  group by all
)"""

SAMPLE = """cells as (select odpt_id, x, y, floor(x / 200000.0) cx, floor(y / 200000.0) cy from shops),
ranked as (select *, row_number() over (partition by cx, cy order by odpt_id) - 1 idx from cells),
counts as (select cx, cy, count(*) cnt from cells group by 1, 2),
homes as (select *, floor(x / 200000.0) ocx, floor(y / 200000.0) ocy from spots where weight > 0),
reach as (
  select *, sum(cnt) over (partition by ocx, ocy order by cx, cy) upto from (
    select h.ocx, h.ocy, c.cx, c.cy, c.cnt from (select distinct ocx, ocy from homes) h
    join counts c on abs(c.cx - h.ocx) <= 4 and abs(c.cy - h.ocy) <= 4)
),
choices as (select ocx, ocy, sum(cnt) m from reach group by 1, 2),
lots as (
  select h.*, m, sum(weight * m) over (order by odpt_id) w_to, sum(weight * m) over (order by odpt_id) - weight * m w_from
  from homes h join choices using (ocx, ocy)
),
draws as (
  select o_orderkey draw_id, (o_orderkey * 7919 % 100003 / 100003.0e0) * (select max(w_to) from lots) aim, o_orderkey * 104729 % 99991 / 99991.0e0 u_d
  from orders
),
chosen as (select d.draw_id, l.odpt_id orig_odpt, l.x, l.y, l.ocx, l.ocy, floor(d.u_d * m) k from draws d join lots l on d.aim >= l.w_from and d.aim < l.w_to),
spot as (
  select c.*, r.cx, r.cy, k - (r.upto - r.cnt) idx from chosen c
  join reach r on r.ocx = c.ocx and r.ocy = c.ocy and k >= r.upto - r.cnt and k < r.upto
),
taken as (
  select s.draw_id, s.orig_odpt, d.odpt_id dest_odpt from spot s join ranked d on d.cx = s.cx and d.cy = s.cy and d.idx = s.idx
  where sqrt((s.x-d.x)*(s.x-d.x) + (s.y-d.y)*(s.y-d.y)) <= 800000
)"""

CHAINS = """e as (select id, src_vid, trg_vid, len_mm len, exists_, is_xwalk from net_edges where exists_),
deg as (select vid, count(*) degree from (select src_vid vid from e union all select trg_vid from e) group by 1),
free as (select vid from deg where degree <= 2 and vid not in (select vid_o from od union select vid_d from od)),
chain0 as (select * from e where not is_xwalk and src_vid in (select vid from free) and trg_vid in (select vid from free)),
nodes as (select src_vid vid from chain0 union select trg_vid from chain0),
ve as (select 0 variant, src_vid, trg_vid from e where src_vid in (select vid from nodes) and trg_vid in (select vid from nodes)),
arcs as (select variant, src_vid u, trg_vid w from ve union all select variant, trg_vid, src_vid from ve)"""
CHAINS2 = """chain as (select c.*, cc.cid from chain0 c join cc on cc.vid = c.src_vid),
touch as (select cid, vid from (select cid, src_vid vid from chain union all select cid, trg_vid from chain) group by 1, 2 having count(*) = 1),
two as (select cid, min(vid) a, max(vid) b from touch group by 1 having count(*) = 2)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "with " + ("recursive " if recursive else "") + ",\n".join(parts) + "\n"


def _graph(*parts: str) -> str:
    return _with(ctes("net_edges", "od"), VE, ARCS, CC, *parts, recursive=True)


def _graph_current(*parts: str) -> str:
    return _with(ctes("net_edges", "od"), VE_CURRENT, ARCS, CC, *parts, recursive=True)


ORACLE: dict[str, str] = {
    "variant_edges": _with(ctes("net_edges"), VE) + "select variant, id, src_vid, trg_vid, len, is_xwalk from ve",
    "label_edges": _with(ctes("net_edges"))
    + "select id, case when exists_ then 'Existing' else 'Proposed' end || case when is_xwalk then ' crosswalk' else ' sidewalk' end category from net_edges",
    "used_nodes": _with(ctes("net_edges"), VE) + "select variant, src_vid vid from ve union select variant, trg_vid from ve",
    "od_aggregate": _with(ctes("od_raw")) + "select orig_odpt, dest_odpt, count(*) n_ods from od_raw group by 1, 2",
    "od_attach": _with(ctes("odpt2node"))
    + """select o.od_id, o.orig_odpt, o.dest_odpt, o.n_ods, a.vid vid_o, b.vid vid_d, a.dist_mm + b.dist_mm dist
from (select min(l_orderkey * 8 + l_linenumber) od_id, 'c' || o_custkey orig_odpt, 's' || l_suppkey dest_odpt, count(*) n_ods
      from lineitem join orders on l_orderkey = o_orderkey group by 2, 3) o
join odpt2node a on a.odpt_id = o.orig_odpt join odpt2node b on b.odpt_id = o.dest_odpt""",
    "node_degrees": _with(ctes("net_edges"))
    + "select vid, count(*) degree from (select src_vid vid from net_edges union all select trg_vid from net_edges) group by 1",
    "dense_node_ids": _with(ctes("net_nodes")) + "select row_number() over (order by y_mm, x_mm, vid) - 1 id, vid from net_nodes",
    "best_links_first": _with(ctes("net_edges"), SCORED)
    + "select id, rnk n_links, cast(sum(len) over (order by rnk) as bigint) length from best",
    "removal_batches": _with(ctes("net_edges"), SCORED)
    + """select id, cast((rnk_worst - 1) // step_size + 1 as int) gone_at from best, setting
union all select id, cast(ceil(n / step_size) + 1 as int) from scored, setting, n_new where exists_""",
    "shortest_link_per_node": _with(ctes("net_edges"), VE.replace("ve as", "ve0 as"), "ve as (select * from ve0 where variant = 'both')", ARCS)
    + "select u, len, id from (select *, row_number() over (partition by u order by len, id) rn from arcs) where rn = 1",
    "filled_gaps": _with(
        """gappy as (
  select month, case when n % 3 = 0 then cast(n as double) end n, case when m % 4 = 1 then cast(m as double) end m, row_number() over (order by month) pos
  from (select cast(strftime(o_orderdate, '%Y%m') as int) as month, count(*) n, count(distinct o_custkey) m from orders group by 1))""",
        FILL.format(c="n", t="gappy"),
        FILL.format(c="m", t="filled_n"),
    )
    + "select month, round(f_n, 6) n, round(f_m, 6) m from filled_m",
    "poi_tags": _with(SHOPS)
    + """select 'way' element_type, odpt_id osmid, t.category || ' ' || (odpt_id % 5) subcategory, t.category, round(x + 2, 3) x, round(y + 2, 3) y
from shops join (values ('amenity', 2), ('healthcare', 7), ('leisure', 3), ('office', 5), ('shop', 4)) t(category, every) on odpt_id % every = 0""",
    "mixed_poi_points": _with(
        SPOTS,
        """moved as (select *, odpt_id % 6 k from spots),
mids as (
  select odpt_id, x + case k when 0 then 0 when 1 then 750 / 40.0e0 when 2 then (64 * 4 - 4 * 2) / 60.0e0 when 3 then 2.5e0
    when 4 then (10 * 5 + 30 * 20) / 40.0e0 else (4 * 1 + 16 * 12) / 20.0e0 end x,
  y + case k when 0 then 0 when 1 then 50 / 40.0e0 when 2 then (64 * 4 - 4 * 2) / 60.0e0 when 3 then 0.5e0
    when 4 then (30 * 15) / 40.0e0 else (4 * 1 + 16 * 2) / 20.0e0 end y from moved
)""",
    )
    + """select cast(odpt_id as bigint) osmid, t.category || ' ' || (odpt_id % 5) subcategory, t.category, round(x, 3) x, round(y, 3) y
from mids join (values ('amenity', 2), ('healthcare', 7), ('leisure', 3), ('office', 5), ('shop', 4)) t(category, every) on odpt_id % every = 0""",
    "gzip_pois": _with(SPOTS) + "select 'p' || odpt_id placekey, y latitude, x longitude from spots",
    "projected_lengths": _with(
        ctes("net_edges", "net_nodes"), LINES,
        # metres of a degree on a sphere of the mean radius
        "unit as (select 6371008.8e0 * pi() / 180 m)",
    )
    + """select eid, round(sqrt(power((x2 / 1e8 - x1 / 1e8) * m * cos(radians(30.0e0)), 2) + power((y2 / 1e9 - y1 / 1e9) * m, 2)), 3) metres from lines, unit""",
    "building_centroids": _with(ctes("net_nodes"))
    + "select vid osmid, 'yes' kind, round(x_mm + 2200.0, 3) x, round(y_mm + 2200.0, 3) y from net_nodes",
    "line_measures": _with(ctes("net_edges", "net_nodes"), LINES)
    + """select eid, round(len, 3) len, round(len / 1000 / 1609.344, 6) miles, round((x1 + x2) / 2, 3) mid_x, round((y1 + y2) / 2, 3) mid_y,
  least(x1, x2) minx, greatest(y1, y2) maxy, cast(floor(len / 5000) as int) + case when len / 5000 = floor(len / 5000) then 1 else 2 end stops
from lines""",
    "great_circle": """with p as (select distinct l_orderkey, l_suppkey, l_partkey from lineitem),
q as (
  select l_suppkey, radians(l_partkey % 120 - 60) la, radians(l_suppkey % 120 - 60) lb,
    radians((l_partkey % 120 - 60) - (l_suppkey % 120 - 60)) / 2 dlat, radians((l_partkey * 7 % 360 - 180) - (l_suppkey * 7 % 360 - 180)) / 2 dlon from p
)
select l_suppkey, count(*) n,
  round(avg(2 * 6371008.8 * asin(sqrt(least(sin(dlat) * sin(dlat) + cos(la) * cos(lb) * sin(dlon) * sin(dlon), 1.0)))) / 1000, 3) km
from q group by 1""",
    "node_in_zone": _with(ctes("net_nodes", "zones"))
    + "select vid, zone_id, dmd_kind from net_nodes join zones on x_mm >= x0 and x_mm < x1 and y_mm >= y0 and y_mm < y1",
    "multi_part_zone": _with(ctes("net_nodes", "zones"))
    + """select vid, zone_id from (select *, (x_mm - x0) / cast(x1 - x0 as double) u, (y_mm - y0) / cast(y1 - y0 as double) v from net_nodes join zones on true)
where v >= 0 and v < 1 and (u >= 0 and u < 0.5 and not (u >= 0.125 and u < 0.375 and v >= 0.25 and v < 0.75) or u >= 0.75 + v / 4 and u < 1)""",
    "zones_meet": _with(ctes("zones"))
    + "select a.zone_id a, b.zone_id b from zones a join zones b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1",
    "edges_near_shops": _with(ctes("net_edges", "net_nodes"), LINES, SHOPS)
    + f"select l.eid, s.odpt_id shop from lines l join shops s on {_piece('s.x', 's.y', 'l')} <= 30000",
    "nearest_node": _with(ctes("net_nodes"), SPOTS)
    + """select odpt_id, vid, round(dist, 3) dist from (
  select *, row_number() over (partition by odpt_id order by dist, vid) rn from (
    select odpt_id, vid, sqrt((x - x_mm) * (x - x_mm) + (y - y_mm) * (y - y_mm)) dist from spots join net_nodes on true)) where rn = 1""",
    "nearest_edge": _with(ctes("net_edges", "net_nodes"), LINES, SPOTS)
    + f"select odpt_id, round(min({_piece('s.x', 's.y', 'l')}), 3) dist from spots s join lines l on true group by 1",
    "city_pois": _with(ctes("zones"), SPOTS)
    + """select 'p' || odpt_id placekey, n_name poi_class from spots join nation on n_nationkey = odpt_id % 50
join zones on zone_id in (6, 7, 12) and x >= x0 and x < x1 and y >= y0 and y < y1""",
    "land_use": """select p_size lu_code, category, dmd_kind, count(*) n from part
join (values (1, 'Single Family', 'O'), (2, 'Duplex', 'O'), (5, 'Office', 'D'), (7, 'Hospital', 'D')) c(lu_code, category, dmd_kind) on p_size = lu_code
group by 1, 2, 3""",
    "census": _with(ctes("zones"))
    + """select '17' || lpad(cast(z.zone_id // 5 as varchar), 3, '0') || '0001' || (z.zone_id % 5) geoid, z.popu_cbg popu from zones z
join zones c on c.zone_id = 12 and z.x0 <= c.x1 and c.x0 <= z.x1 and z.y0 <= c.y1 and c.y0 <= z.y1""",
    "od_points": _with(
        ctes("net_nodes", "zones"), SHOPS,
        """bld as (select vid, x_mm x, y_mm y, z.zone_id, z.dmd_kind = 'O' origin, n_regionkey, popu_cbg
  from net_nodes join zones z on x_mm >= x0 and x_mm < x1 and y_mm >= y0 and y_mm < y1)""",
        "share as (select zone_id, least(max(popu_cbg) / count(*), 50) weight from bld where origin group by 1)",
        """pts as (
  select origin, 'b' || vid base_id, 'ZONE ' || n_regionkey category, case when origin then weight else 0 end weight, 'building' source
  from bld join share using (zone_id)
  union all select false, 's' || odpt_id, 'SHOP', 0, 'osm' from shops)""",
    )
    + "select row_number() over (order by source, base_id, category) - 1 id, origin, base_id, category, round(cast(weight as double), 6) weight, source from pts",
    "odpt_to_node": _with(ctes("net_edges", "net_nodes"), LINES, SPOTS, NEAREST_STOP)
    + """select odpt_id, case when s.pos <= s.len / 2 then s.a else s.b end vid, s.pos <= s.len / 2 is_source, round(d, 3) dist_odpt2cp,
  round(case when s.pos <= s.len / 2 then s.pos else s.len - s.pos end, 3) dist_cp2node from entry""",
    "sample_od": _with(SPOTS, SHOPS, SAMPLE)
    + """select od_id, orig_odpt, dest_odpt from (select row_number() over (order by draw_id) - 1 od_id, orig_odpt, dest_odpt from taken)
where od_id < (select count(*) // 3 from orders)""",
    "sample_round_trip": _with(SPOTS, SHOPS, SAMPLE)
    + """select od_id, orig_odpt, dest_odpt from (select row_number() over (order by draw_id) - 1 od_id, orig_odpt, dest_odpt from taken)
where od_id < (select count(*) // 3 from orders)""",
    "intersections": _with(ctes("street_roads"), STREETS) + "select ixn_id, x, y from ixns",
    "candidate_crosswalks": _candidate(""),
    "candidate_crosswalks_own_intersection": _candidate("where ixn_id = ixn_uid"),
    "base_network": _with(
        ctes("street_sidewalks", "street_crosswalks"),
        """l as (
  select id, x1, y1, x2, y2, false is_xwalk, true exists_ from street_sidewalks
  union all select id, x1, y1, x2, y2, true, true from street_crosswalks
  union all select id, x1 + 84, y1, x2 + 84, y2, true, false from street_crosswalks)""",
        "v as (select row_number() over (order by x, y) - 1 vid, x, y from (select x1 x, y1 y from l union select x2, y2 from l))",
    )
    + """select cast(row_number() over (order by is_xwalk, exists_ desc, l.id) - 1 as int) eid, l.id orig_id, exists_ "exists", is_xwalk,
  round(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)), 6) len, cast(a.vid as int) src_vid, cast(b.vid as int) trg_vid, x1 x_o, y1 y_o, x2 x_d, y2 y_d
from l join v a on a.x = x1 and a.y = y1 join v b on b.x = x2 and b.y = y2""",
    "snapped_crosswalks": _with(
        ctes("street_sidewalks", "street_crosswalks"),
        "pts as (select x1 x, y1 y from street_sidewalks union select x2, y2 from street_sidewalks)",
        "ends as (select id, 1 k, x1 + 3 x, y1 - 1 y from street_crosswalks union all select id, 2, x2 + 3, y2 - 1 from street_crosswalks)",
        """hit as (select id, k, min({'d': sqrt((e.x-p.x)*(e.x-p.x) + (e.y-p.y)*(e.y-p.y)), 'x': p.x, 'y': p.y}) b
  from ends e join pts p on true group by 1, 2)""",
    )
    + "select a.id, a.b.x x1, a.b.y y1, c.b.x x2, c.b.y y2 from hit a join hit c on c.id = a.id and a.k = 1 and c.k = 2",
    "nearest_road": _with(
        ctes("street_roads", "street_crosswalks"),
        # crosswalks and roads are level or upright here: two boxes, one of them thin, meet if the lines do
        f"""near as (
  select c.id, r.id road_id, case when least(c.x1, c.x2) <= greatest(r.x1, r.x2) and least(r.x1, r.x2) <= greatest(c.x1, c.x2)
    and least(c.y1, c.y2) <= greatest(r.y1, r.y2) and least(r.y1, r.y2) <= greatest(c.y1, c.y2) then 0.0 else least(
    {_piece('c.x1', 'c.y1', 'r')}, {_piece('c.x2', 'c.y2', 'r')}, {_piece('r.x1', 'r.y1', 'c')}, {_piece('r.x2', 'r.y2', 'c')}) end d
  from walks c join street_roads r on true
)""".replace("near as", "walks as (select id, x1 + 3 x1, y1 + case when id % 16 = 0 then 9 else 0 end y1, x2 + 3 x2, y2 + case when id % 16 = 0 then 9 else 0 end y2 from street_crosswalks),\nnear as"),
        "hit as (select id, min({'d': d, 'id': road_id}) b from near group by 1)",
    )
    + "select id, b.id road_id, round(b.d, 6) dist from hit",
    "part_flags": """select p_partkey, coalesce(p_brand = 'Brand#13', false) is_brand, coalesce(p_size in (1, 5, 24), false) is_size from part""",
    "parts_exploded": """select p_partkey, p_partkey::double x1, 0.0::double y1, p_partkey::double x2, p_size::double y2 from part where p_size > 10
union all select p_partkey, p_partkey::double, p_size::double, p_partkey::double, 2 * p_size::double from part where p_size > 10""",
    "unlinked_pairs": _with(ctes("net_edges"))
    + """select id, src_vid, trg_vid from net_edges n where not exists_ and not exists (select 1 from net_edges e
where e.exists_ and (e.src_vid = n.src_vid and e.trg_vid = n.trg_vid or e.src_vid = n.trg_vid and e.trg_vid = n.src_vid))""",
    "chains_contracted": _with(ctes("net_edges", "od"), CHAINS, CC, CHAINS2, recursive=True)
    + """select cast(id as varchar) eids, id orig_id, is_xwalk, src_vid, trg_vid, len from e
where id not in (select c.id from chain c join two using (cid))
union all
select string_agg(cast(c.id as varchar), ',' order by c.id), -1, false, t.a, t.b, cast(sum(c.len) as bigint) from two t join chain c using (cid) group by t.cid, t.a, t.b""",
    "chain_shapes": _with(ctes("net_edges", "od", "net_nodes"), CHAINS, CC, CHAINS2, LINES, recursive=True)
    + """select cast(id as varchar) eids, 1 n_parts, round(l.len, 3) length from e join lines l on l.eid = id
where id not in (select c.id from chain c join two using (cid))
union all
select string_agg(cast(c.id as varchar), ',' order by c.id), cast(count(*) as int), round(sum(l.len), 3) from two t join chain c using (cid)
join lines l on l.eid = c.id group by t.cid""",
    "components": _with(ctes("net_edges"), VE, ARCS, CC, recursive=True) + "select variant, vid, cid from cc",
    "edges_by_component": _with(ctes("net_edges"), VE, ARCS, CC, recursive=True)
    + "select e.variant, cid, count(*) n_edges, cast(sum(len) as bigint) len from ve e join cc on cc.variant = e.variant and vid = src_vid group by 1, 2",
    "trips_connected": _graph(PAIRS) + "select variant, cast(sum(n_ods) as bigint) n_trips from pairs group by 1",
    "shortest_distances": _graph(PAIRS, SP_FAR)
    + "select p.variant, vid_o, vid_d, n_ods, d from pairs p join sp on sp.variant = p.variant and o = vid_o and v = vid_d",
    "shortest_paths": _graph(PAIRS, SP_FAR, PRED, WALK) + "select variant, vid_o, vid_d, edge_id, hop from walk",
    "edge_trips": _graph(PAIRS, SP_FAR, PRED, WALK)
    + """select e.variant, e.id, cast(coalesce(sum(w.n_ods), 0) as bigint) n_trips from ve e
left join walk w on w.variant = e.variant and w.edge_id = e.id group by 1, 2""",
    "shortest_distances_current": _graph_current(PAIRS, SP)
    + "select vid_o, vid_d, n_ods, d from pairs p join sp on sp.variant = p.variant and o = vid_o and v = vid_d",
    "shortest_paths_current": _graph_current(PAIRS, SP, PRED, WALK) + "select vid_o, vid_d, edge_id, hop from walk",
    "edge_trips_current": _graph_current(PAIRS, SP, PRED, WALK)
    + """select e.id, cast(coalesce(sum(w.n_ods), 0) as bigint) n_trips from ve e
left join walk w on w.variant = e.variant and w.edge_id = e.id group by 1""",
    "betweenness_current": _with(ctes("net_edges"), VE_CURRENT, ARCS, BETWEEN, recursive=True)
    + "select e.id, round(coalesce(bwness, 0), 4) bwness from ve e left join bw using (id)",
    "pedscore_current": _with(
        ctes("net_edges", "od"), VE_CURRENT, ARCS, CC, PAIRS, BETWEEN, PRED, WALK,
        "used as (select edge_id id, sum(n_ods) n from walk group by 1)", recursive=True,
    )
    + """select e.id, cast(coalesce(n, 0) as bigint) n_trips, round(log10(1 + coalesce(n, 0) * coalesce(bwness, 0)), 6) pedscore
from ve e left join bw using (id) left join used using (id)""",
    "rerouted": _with(ctes("net_edges", "od"), SCORED, DIST_STEPS, recursive=True)
    + "select vid_o, vid_d, n_ods, d from step_dist where step = 1",
    "rerouted_paths": _with(
        ctes("net_edges", "od"), SCORED, re.sub(r"dsteps as .*? step\)", "dsteps as (select 1 step)", DIST_STEPS), PRED, WALK, recursive=True
    )
    + "select vid_o, vid_d, edge_id, hop from walk",
    "links_vs_trips": _with(ctes("net_edges", "od"), SCORED, TRIPS_STEPS, CC, TRIPS_CURVE, recursive=True)
    + "select n_links, round(pct_links, 6) pct_links, round(pct_new_trips, 6) pct_new_trips, length, n_trips from curve",
    "distance_steps": _with(ctes("net_edges", "od"), SCORED, DIST_STEPS, recursive=True)
    + "select cast(step as int) step, vid_o, vid_d, n_ods, d from step_dist",
    "mean_distance": _with(ctes("net_edges", "od"), SCORED, DIST_STEPS, DIST_CURVE, recursive=True)
    + "select step, n_links, n_left, round(d_mean, 4) d_mean, round(delta_mean, 4) delta_mean from mean_curve",
    "benefit_cost": _with(
        ctes("net_edges", "od"), SCORED,
        *[p.replace("ve as", "ve1 as").replace("arcs as", "arcs1 as").replace("from ve ", "from ve1 ").replace("from ve)", "from ve1)") for p in (TRIPS_STEPS,)],
        CC.replace("arcs", "arcs1"), TRIPS_CURVE, DIST_STEPS, DIST_CURVE,
        """both_curves as (
  select coalesce(c.n_links, m.n_links) n_links, pct_new_trips, cast(length as double) length, delta_mean,
    row_number() over (order by coalesce(c.n_links, m.n_links)) pos
  from curve c full join mean_curve m on m.n_links = c.n_links)""",
        FILL.format(c="pct_new_trips", t="both_curves"),
        FILL.format(c="length", t="filled_pct_new_trips"),
        FILL.format(c="delta_mean", t="filled_length"),
        recursive=True,
    )
    + """select n_links, round(f_pct_new_trips, 4) pct_new_trips, round(f_delta_mean, 4) delta_mean,
  round(100.0 * f_length / max(f_length) over (), 4) pct_length, round(f_length * 0.001 / 1609.344, 4) length_mi from filled_delta_mean""",
    "layer_round_trip": _with(ctes("net_edges"), VE)
    + """select id, src_vid, trg_vid, len, exists_ "exists", is_xwalk from ve where variant = 'sidewalks'""",
    "reprojected_layer": _with(
        ctes("net_edges", "net_nodes"), LINES,
        """flat as (select eid, 6378137 * radians(x1 / 1e8 - 97) a, 6378137 * ln(tan(radians(y1 / 1e9 + 30) / 2 + pi() / 4)) b,
  6378137 * radians(x2 / 1e8 - 97) c, 6378137 * ln(tan(radians(y2 / 1e9 + 30) / 2 + pi() / 4)) e from lines)""",
    )
    + """select eid, case when eid % 2 = 0 then 'test_city' else 'other_city' end city, round(sqrt(power(c - a, 2) + power(e - b, 2)), 2) metres from flat""",
    "snapshot_round_trip": _with(ctes("net_edges", "od"), SCORED, DIST_STEPS, recursive=True)
    + """select kind, cast(step as int) step, vid_o, vid_d, n_ods, cast(d * f as bigint) d
from step_dist join (values ('usage', 1), ('twice', 2)) k(kind, f) on true
where step in (select unnest([0, max(step) // 2, max(step)]) from step_dist)""",
    "feature_round_trip": _with(ctes("net_edges", "net_nodes"), LINES)
    + """select eid, case when exists_ then 'Existing' else 'Proposed' end || case when is_xwalk then ' crosswalk' else ' sidewalk' end category,
  round(len, 3) len from lines join net_edges on id = eid""",
}
