"""Network, demand and street tables derived from the generated tables, as SQL text.

The same text runs in Spark (``table``) and in the comparison engine (``ctes``), so that
both sides of a check read identical inputs.  Only where the text overflows on tall networks Spark runs
another condition for the same rows (``GUARDED``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("part", "customer", "supplier", "orders", "lineitem", "nation")

TABLES: dict[str, str] = {
    "net_nodes": """
select cast(p_partkey as int) vid,
       (p_partkey % 20)*100000 + (p_size % 7)*1000 x_mm,
       cast(floor(p_partkey/20.0) as bigint)*100000 + (p_size % 11)*1000 y_mm
from {part}""",
    "net_edges": """
select cast(e.id as int) id, cast(e.src_vid as int) src_vid, cast(e.trg_vid as int) trg_vid,
       e.len_mm, e.exists_, e.is_xwalk
from (
  select 2*p_partkey id, p_partkey src_vid, p_partkey+1 trg_vid,
         cast(90000+(p_size % 4)*10000 as bigint) len_mm, (p_size % 5) < 2 exists_, p_partkey % 3 = 0 is_xwalk, p_size
  from {part} where p_partkey % 20 < 19
  union all
  select 2*p_partkey+1, p_partkey, p_partkey+20,
         cast(100000+(p_size % 3)*10000 as bigint), ((p_size*3+p_partkey) % 7) < 3, p_partkey % 3 = 1, p_size+3
  from {part} where p_partkey+20 < (select count(*) from {part})
) e where e.p_size % 10 <> 9""",
    "odpt2node": """
select concat('c', cast(c_custkey as string)) odpt_id,
       cast((c_custkey*7) % (select count(*) from {part}) as int) vid,
       cast((c_custkey % 13)*1000 as bigint) dist_mm, true is_origin,
       case when c_acctbal>0 then c_acctbal else 0 end weight
from {customer}
union all
select concat('s', cast(s_suppkey as string)),
       cast((s_suppkey*13) % (select count(*) from {part}) as int),
       cast((s_suppkey % 7)*1000 as bigint), false, 0
from {supplier}""",
    "od_raw": """
select concat('c', cast(o_custkey as string)) orig_odpt, concat('s', cast(l_suppkey as string)) dest_odpt
from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    "od": """
select orig_odpt, dest_odpt, n_ods, a.vid vid_o, b.vid vid_d, a.dist_mm+b.dist_mm dist_mm
from (select orig_odpt, dest_odpt, count(*) n_ods from {od_raw} group by 1,2) o
join {odpt2node} a on orig_odpt=a.odpt_id join {odpt2node} b on dest_odpt=b.odpt_id
join {net_nodes} na on na.vid=a.vid join {net_nodes} nb on nb.vid=b.vid
where (na.x_mm-nb.x_mm)*(na.x_mm-nb.x_mm)+(na.y_mm-nb.y_mm)*(na.y_mm-nb.y_mm) <= 640000000000""",
    "zones": """
select n_nationkey zone_id, n_regionkey, case when n_regionkey in (0,1,2) then 'O' else 'D' end dmd_kind,
       1000+n_nationkey*137 popu_cbg,
       (n_nationkey % 5)*400000 x0, (n_nationkey % 5)*400000+400000 x1,
       cast(floor(n_nationkey/5.0) as bigint)*(select count(*) from {part})*1000 y0,
       (cast(floor(n_nationkey/5.0) as bigint)+1)*(select count(*) from {part})*1000 y1
from {nation}""",
    # streets, in metres: straight lines from (x1, y1) to (x2, y2)
    "street_roads": """
select cast(2*p_partkey as int) id, (p_partkey%20)*100.0e0 x1, floor(p_partkey/20.0e0)*100.0e0 y1,
       (p_partkey%20)*100.0e0+100.0e0 x2, floor(p_partkey/20.0e0)*100.0e0 y2
from {part} where p_partkey%20 < 19
union all
select cast(2*p_partkey+1 as int), (p_partkey%20)*100.0e0, floor(p_partkey/20.0e0)*100.0e0,
       (p_partkey%20)*100.0e0, floor(p_partkey/20.0e0)*100.0e0+100.0e0
from {part} where p_partkey+20 < (select count(*) from {part})""",
    "street_sidewalks": """
select cast(r.id*2 + (s.s+1)/2 as int) id,
       case when r.y1=r.y2 then r.x1+8 else r.x1+6*s.s end x1, case when r.y1=r.y2 then r.y1+6*s.s else r.y1+8 end y1,
       case when r.y1=r.y2 then r.x1+92 else r.x1+6*s.s end x2, case when r.y1=r.y2 then r.y1+6*s.s else r.y1+92 end y2
from {street_roads} r join (select -1 s union all select 1 s) s on true""",
    "street_crosswalks": """
select cast(r.id as int) id, r.x1+8 x1, case when r.id % 16 = 0 then r.y1-6 else r.y1+6 end y1,
       r.x1+8 x2, case when r.id % 16 = 0 then r.y1+6 else r.y1-6 end y2
from {street_roads} r where r.id % 8 = 0""",
}

_IN_RANGE = "(na.x_mm-nb.x_mm)*(na.x_mm-nb.x_mm)+(na.y_mm-nb.y_mm)*(na.y_mm-nb.y_mm) <= 640000000000"
# Squares of places more than 3,000 km apart leave 64 bits; farther than 800 m along an axis, none need be taken.
GUARDED: dict[str, tuple[str, str]] = {
    "od": (_IN_RANGE, f"case when abs(na.x_mm-nb.x_mm) <= 800000 and abs(na.y_mm-nb.y_mm) <= 800000 then {_IN_RANGE} else false end"),
}


def _needs(name: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", TABLES[name]))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TABLES[name].replace(*GUARDED.get(name, ("", ""))), **{n: table(spark, sf_dir, n) for n in _needs(name)})


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges under the column names of the operators (length in millimetres)."""
    return table(spark, sf_dir, "net_edges").withColumnsRenamed({"exists_": "exists", "len_mm": "len"})


def ctes(*names: str) -> str:
    """``name as (...)`` for the named tables and all they need, in order, comma separated."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name in BASE:
            return
        for n in _needs(name):
            add(n)
        text = re.sub(r"\{(\w+)\}", r"\1", TABLES[name])
        done[name] = f"{name} as ({text}\n)"

    for n in names:
        add(n)
    return ",\n".join(done.values())
