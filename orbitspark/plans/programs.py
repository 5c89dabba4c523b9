"""Queries that run whole identity, overview, audit and filing programs on the driver's tables, each beside its SQL.

The tables stand in for a catalogue: suppliers and customers for entities of two sources, parts for rows of a third, nations for
organisations and operators, orders for claims, status and filings, events for element sets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import documents
from . import gold, identity, metrics, reports
from .standins import query, r9, table


def _designator(k, letter: str, modulus: int):
    """A designator written loosely: blanks and no leading zeros."""
    return F.concat(F.lit(" 2000 "), (F.col(k) % modulus + 1).cast("string"), F.lit(letter.lower()))


def _none():
    return F.lit(None).cast("date")


# ------------------------------------------------------------------ identity
def _catalogue(spark, d) -> tuple[DataFrame, DataFrame]:
    """Entities that are there already, and no identifiers yet."""
    s = table(spark, d, "supplier")
    satellites = s.select(
        F.col("s_suppkey").alias("satellite_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("norad_id"), F.format_string("2000-%03dA", F.col("s_suppkey") % 90 + 1).alias("cospar"), F.col("s_name").alias("canonical_name"),
        F.lit("PAYLOAD").alias("object_type"), _none().alias("launch_date"), _none().alias("decay_date"), F.lit("anchored").alias("anchor_state"),
    )
    return satellites, spark.createDataFrame([], "satellite_id long, id_type string, id_value string, source string, confidence decimal(3,2), valid_from date, valid_to date")


def _matched(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    satellites, ids = _catalogue(spark, d)
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("norad_id"), F.col("c_name").alias("name"), _designator("c_custkey", "B", 700).alias("cospar"), F.lit("P").alias("object_type"), _none().alias("launch_date"))
    satellites, ids, _ = identity.match_by_catalogue_id(satellites, ids, c, "cat")
    p = table(spark, d, "part").where("p_partkey % 7 <> 0")
    p = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("source_key"), F.when(F.col("p_partkey") % 2 == 0, _designator("p_partkey", "A", 990)).otherwise(_designator("p_partkey", "B", 990)).alias("cospar"), F.col("p_name").alias("name"), F.lit("P").alias("object_type"), _none().alias("launch_date"))
    satellites, ids, _, ambiguous = identity.match_by_designator(satellites, ids, p, "list")
    return satellites, ids, ambiguous


_MATCH = """with sat0 as (select s_suppkey as id, case when s_suppkey % 3 <> 0 then s_suppkey end as norad, printf('2000-%03dA', s_suppkey % 90 + 1) as cospar from supplier),
cat as (select c_custkey as norad, printf('2000-%03dB', c_custkey % 700 + 1) as cospar from customer where c_custkey % 5 <> 0),
sat1 as (select * from sat0 union all select (select max(id) from sat0) + row_number() over (order by norad), norad, cospar from cat where norad not in (select norad from sat0 where norad is not null)),
link1 as (select id as satellite_id, 'norad' as id_type, norad::varchar as id_value, 'cat' as source from cat join sat1 using (norad)),
lst as (select 'P' || p_partkey as sk, printf('2000-%03d', p_partkey % 990 + 1) || case when p_partkey % 2 = 0 then 'A' else 'B' end as cospar from part where p_partkey % 7 <> 0),
known as (select cospar, min(id) as id, count(*) as n from sat1 group by 1),
made as (select cospar, (select max(id) from sat1) + row_number() over (order by cospar) as id from (select distinct cospar from lst where cospar not in (select cospar from known))),
link2 as (select id as satellite_id, 'source_key' as id_type, sk as id_value, 'list' as source from lst join (select cospar, id from known union all select cospar, id from made) using (cospar)) """


@query(_MATCH + "select * from link1 union all select * from link2")
def v22_matching(spark, d):
    """Identifiers after both deterministic rules: by catalogue id, then by designator, entities being made where none is known."""
    return _matched(spark, d)[1].select("satellite_id", "id_type", "id_value", "source")


@query(_MATCH + "select id as satellite_id, norad as norad_id, cospar, 'anchored' as anchor_state from sat1 union all select id, null, cospar, 'provisional' from made")
def v22_entities(spark, d):
    return _matched(spark, d)[0].select("satellite_id", "norad_id", "cospar", "anchor_state")


@query(_MATCH + "select cospar, n from known where n > 1 and cospar in (select cospar from lst)")
def v22_ambiguous(spark, d):
    """Designators that several entities share."""
    return _matched(spark, d)[2]


def _twins(spark, d) -> DataFrame:
    day = lambda k: F.when(F.col(k) % 11 != 0, F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col(k) % 5).cast("int")))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("satellite_id"), F.lit(None).cast("long").alias("norad_id"), F.format_string("2000-%03dA", F.col("s_suppkey") % 999).alias("cospar"), F.concat(F.lit("Sat-"), (F.col("s_suppkey") % 999).cast("string")).alias("canonical_name"), day("s_suppkey").alias("launch_date"))
    c = table(spark, d, "customer").where("c_custkey < 700 or c_custkey % 9 = 0").withColumn("k", F.col("c_custkey") % 700)
    name = F.when(F.col("c_custkey") % 3 == 0, "OBJECT A").when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("SAT "), F.col("k").cast("string"))).otherwise("Other")
    c = c.select(F.col("c_custkey").alias("satellite_id"), F.col("c_custkey").alias("norad_id"), F.format_string("2000-%03dA", "k").alias("cospar"), name.alias("canonical_name"), F.date_add(day("k"), F.when(F.col("c_custkey") % 13 == 0, 1).otherwise(0)).alias("launch_date"))
    return s.unionByName(c).withColumns({"object_type": F.lit("PAYLOAD"), "decay_date": _none(), "anchor_state": F.lit("x")})


_TWINS = """with p as (select s_suppkey + 1000000 as pid, printf('2000-%03dA', s_suppkey % 999) as cospar, 'Sat-' || s_suppkey % 999 as pn, case when s_suppkey % 11 <> 0 then date '2000-01-01' + (s_suppkey % 5)::integer end as pl from supplier),
a as (select c_custkey as aid, printf('2000-%03dA', c_custkey % 700) as cospar, case c_custkey % 3 when 0 then 'OBJECT A' when 1 then 'SAT ' || c_custkey % 700 else 'Other' end as an, case when (c_custkey % 700) % 11 <> 0 then date '2000-01-01' + ((c_custkey % 700) % 5 + case when c_custkey % 13 = 0 then 1 else 0 end)::integer end as al from customer where c_custkey < 700 or c_custkey % 9 = 0),
one as (select pid as merged_id, min(aid) as surviving_id, any_value(cospar) as cospar, max(pn) as pn, max(an) as an from p join a using (cospar) where pl is not distinct from al group by 1 having count(distinct aid) = 1),
v as (select *, case when regexp_matches(upper(an), '\\bOBJECT\\b') or lower(replace(pn, '-', ' ')) = lower(an) then 'merged' else 'declined' end as decision from one) """


@query(_TWINS + "select merged_id, surviving_id, cospar, decision from v")
def v24_promotion(spark, d):
    """Provisional entities whose designator and launch date are those of exactly one anchored one, and the name gate's verdict."""
    return identity.promotion_pairs(_twins(spark, d)).select("merged_id", "surviving_id", "cospar", "decision")


@query(_TWINS + """, ids as (select pid as satellite_id, 'k' || pid % 3 as id_value from p union all select aid, 'k' || aid % 2 from a)
select distinct coalesce(surviving_id, satellite_id) as satellite_id, id_value from ids left join (select * from v where decision = 'merged') on merged_id = satellite_id""")
def v24_promoted_identifiers(spark, d):
    """A child table after the merges: the survivors have the merged ones' keys, each once."""
    both = _twins(spark, d)
    keys = F.when(F.col("norad_id").isNull(), F.col("satellite_id") % 3).otherwise(F.col("satellite_id") % 2)
    child = both.select("satellite_id", F.concat(F.lit("k"), keys.cast("string")).alias("id_value"))
    return identity.promote(both, {"ids": (child, ["satellite_id", "id_value"])})[1]["ids"]


_ORGS = """with recursive org as (select 'C' || n_nationkey as code, case when n_nationkey > 0 then 'C' || n_nationkey // 2 end as parent_code, n_nationkey % 5 <> 3 as b, n_name as display_name from nation),
walk as (select code as leaf, code as cur, 0 as depth from org union all select w.leaf, e.parent_code, w.depth + 1 from walk w join org e on e.code = w.cur join org p on p.code = e.parent_code where p.b and w.depth < 10 and e.parent_code <> w.cur),
up as (select leaf, cur as root, depth from (select *, row_number() over (partition by leaf order by depth desc) as rn from walk) where rn = 1),
"""


def _orgs(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.concat(F.lit("C"), n.cast("string")).alias("code"), F.when(n > 0, F.concat(F.lit("C"), F.floor(n / 2).cast("string"))).alias("parent_code"), F.when(n % 5 != 3, "B").otherwise("S").alias("org_class"), F.col("n_name").alias("display_name"))


@query(_ORGS + """rows as (select 'P' || p_partkey as source_key, case when p_partkey % 3 <> 0 then p_partkey end as norad_id, printf('2000-%03dA', p_partkey % 900) as cospar, p_type as bus, p_partkey % 5 = 0 as unsure, 'C' || p_partkey % 29 as code from part),
x as (select c_custkey as satellite_id, case when c_custkey % 2 = 0 then c_custkey end as norad_id, case when c_custkey % 2 = 1 and c_custkey < 900 then printf('2000-%03dA', c_custkey) end as cospar, case when c_custkey % 5 = 0 then 'P' || c_custkey end as source_key from customer),
slugged as (select *, nullif(trim(regexp_replace(lower(bus), '[^a-z0-9]+', '-', 'g'), '-'), '') as bus_slug from rows),
cand as (select satellite_id, 'anchored_norad' as join_rule, 1 as k, s.* from slugged s join x on x.norad_id = s.norad_id union all select satellite_id, 'anchored_cospar', 2, s.* from slugged s join x on x.cospar = s.cospar union all select satellite_id, 'provisional', 3, s.* from slugged s join x on x.source_key = s.source_key),
won as (select * from (select *, row_number() over (partition by satellite_id order by k, bus_slug nulls last, source_key) as rn from cand) where rn = 1)
select satellite_id, join_rule, bus_slug, unsure as bus_uncertain, lower(coalesce(root, won.code)) as manufacturer_slug, coalesce(display_name, root, won.code) as manufacturer_name, case when root is null then 'unresolved' when depth = 0 then 'leaf' else 'gcat_orgs' end as rollup_source
from won left join up on up.leaf = won.code left join org on org.code = coalesce(root, won.code)""")
def v31_products(spark, d):
    """Each entity's product and maker: by catalogue id, designator, then source key; makers rolled up to their group."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("source_key"), F.when(k % 3 != 0, k).alias("norad_id"), F.format_string(" 2000-%d a", k % 900).alias("piece"), F.concat("p_type", F.when(k % 5 == 0, "?").otherwise("")).alias("bus"), F.concat(F.lit("C"), (k % 29).cast("string"), F.lit("?/X/")).alias("manufacturer")
    )
    c = F.col("c_custkey")
    crosswalk = table(spark, d, "customer").select(c.alias("satellite_id"), F.when(c % 2 == 0, c).alias("norad_id"), F.when((c % 2 == 1) & (c < 900), F.format_string("2000-%03dA", c)).alias("cospar"), F.when(c % 5 == 0, F.concat(F.lit("P"), c.cast("string"))).alias("source_key"))
    return identity.attribute_products(rows, crosswalk, _orgs(spark, d)).select("satellite_id", "join_rule", "bus_slug", "bus_uncertain", "manufacturer_slug", "manufacturer_name", "rollup_source")


@query(_ORGS + """raw as (select p_partkey as satellite_id, 'C' || p_partkey % 29 || '?/ C' || p_partkey % 7 || case when p_partkey % 2 = 0 then '?' else '' end || '//C' || p_partkey % 3 as m from part),
tok as (select satellite_id, unnest(string_split(m, '/')) as t, generate_subscripts(string_split(m, '/'), 1) as position, len(string_split(m, '/')) as arity from raw),
kept as (select satellite_id, position, arity, contains(t, '?') as uncertain, nullif(trim(rtrim(trim(t), '?')), '') as code from tok),
slugged as (select satellite_id, lower(coalesce(root, code)) as slug, position, arity, uncertain from kept left join up on leaf = code where code is not null and (position = 1 or not uncertain))
select satellite_id, slug as manufacturer_slug, position::smallint as position, arity::smallint as arity, uncertain from (select *, row_number() over (partition by satellite_id, slug order by position) as rn from slugged) where rn = 1""")
def v32_credits(spark, d):
    """A credit for each maker that a joint build names, rolled up to its group, at its first place; marked guesses count in the first
    place only."""
    from ..operators.relational import walk_up

    k = lambda m: F.concat(F.lit("C"), (F.col("p_partkey") % m).cast("string"))
    raw = F.concat(k(29), F.lit("?/ "), k(7), F.when(F.col("p_partkey") % 2 == 0, "?").otherwise(""), F.lit("//"), k(3))
    orgs = _orgs(spark, d)
    up = walk_up(orgs.select("code", "parent_code"), orgs.where("org_class = 'B'").select("code"))
    return identity.credits(table(spark, d, "part").select(F.col("p_partkey").alias("satellite_id"), raw.alias("manufacturer_raw")), up)


_GRANTS = """with g as (select o_orderkey as k, 'S' || o_orderkey as call_sign, case o_orderkey % 3 when 0 then 'Big Fleet No ' || o_orderkey when 1 then 'customer ' || lpad((o_orderkey % 997)::varchar, 9, '0') else 'Nobody' end as name, (o_orderkey % 4)::varchar as frequency_range from orders where o_orderkey % 10 < 3),
e as (select c_custkey as satellite_id, case when c_custkey % 4 = 0 then 'FLEET-' || c_custkey % 50 else 'Customer#' || lpad((c_custkey % 800)::varchar, 9, '0') end as name from customer where c_custkey < 1200) """


@query(_GRANTS + """, t1 as (select distinct satellite_id, call_sign, frequency_range, 'pattern' as match_tier from g, e where contains(lower(g.name), 'big fleet') and starts_with(lower(e.name), 'fleet-1')),
u as (select lower(replace(name, '#', ' ')) as nm, min(satellite_id) as satellite_id from e group by 1 having count(*) = 1),
t2 as (select distinct u.satellite_id, call_sign, frequency_range, 'name' as match_tier from g join u on u.nm = lower(g.name))
select * from t1 union all select * from t2 where (call_sign, frequency_range) not in (select (call_sign, frequency_range) from t1)""")
def v33_authorisations(spark, d):
    """Grants by curated pattern, then by a name that exactly one entity bears."""
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Big Fleet No "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("customer "), F.lpad((k % 997).cast("string"), 9, "0"))).otherwise("Nobody")
    grants = table(spark, d, "orders").where("o_orderkey % 10 < 3").select(F.concat(F.lit("S"), k.cast("string")).alias("call_sign"), name.alias("name"), (k % 4).cast("string").alias("frequency_range"))
    c = F.col("c_custkey")
    entities = table(spark, d, "customer").where("c_custkey < 1200").select(c.alias("satellite_id"), F.when(c % 4 == 0, F.concat(F.lit("FLEET-"), (c % 50).cast("string"))).otherwise(F.concat(F.lit("Customer#"), F.lpad((c % 800).cast("string"), 9, "0"))).alias("name"))
    patterns = spark.createDataFrame([("Big Fleet", "FLEET-1"), ("nothing", "zzz")], "grant_like string, entity_prefix string")
    return identity.authorisations(grants, entities, patterns)


_ENRICH = """with seed as (select n_name as name, case when n_nationkey % 2 = 0 then 'K' || n_nationkey end as code from nation where n_nationkey < 12),
orgs as (select 'K' || s_suppkey as code, case when s_suppkey % 4 = 0 then (select n_name from nation where n_nationkey = s_suppkey % 25) when s_suppkey % 4 = 1 then lower((select n_name from nation where n_nationkey = s_suppkey % 25)) else s_name end as name, case when s_suppkey % 3 = 0 then 'K' || s_suppkey // 3 end as parent_code from supplier),
fresh as (select * from orgs where code not in (select code from seed where code is not null)),
named as (select *, row_number() over (partition by lower(name) order by code) as rn, lower(name) in (select lower(name) from seed) as taken from fresh),
made as (select code, case when rn = 1 and not taken then name else name || ' (' || code || ')' end as name from named),
alias as (select code, name from seed where code is not null union all select code, name from made) """


@query(_ENRICH + "select distinct name, false as made from seed union all select name, true from made")
def v30_operators(spark, d):
    """Operators after the organisations' codes are added: seeds win, and a name that is taken gets its code behind it."""
    return _enriched(spark, d)[0]


@query(_ENRICH + "select distinct a.name as child, b.name as parent from orgs o join alias a on a.code = o.code join alias b on b.code = o.parent_code where a.name <> b.name")
def v30_edges(spark, d):
    return _enriched(spark, d)[2]


def _enriched(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    seeds = n.where("n_nationkey < 12").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("K"), F.col("n_nationkey").cast("string"))).alias("code"))
    s = table(spark, d, "supplier").join(n, F.col("s_suppkey") % 25 == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.lower("n_name")).otherwise(F.col("s_name"))
    return identity.enrich_operators(seeds, s.select(F.concat(F.lit("K"), k.cast("string")).alias("code"), name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("K"), F.floor(k / 3).cast("string"))).alias("parent_code")))


# ------------------------------------------------------------------ overview and audit
def _graph(spark, d) -> dict[str, DataFrame]:
    """Customers as entities, their orders as status and claims, nations as operators, users' events as elements and days."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    satellite = c.select(k.alias("satellite_id"), F.when(k % 6 != 0, k).alias("norad_id"), F.when(k % 10 != 0, "PAYLOAD").otherwise("DEBRIS").alias("object_type"), F.date_add(F.lit(dt.date(2000, 1, 1)), (k * 7 % 600).cast("int")).alias("launch_date"))
    status = o.select(F.col("o_custkey").alias("satellite_id"), F.when(F.col("o_orderstatus") == "F", "DECAYED").when(F.col("o_orderpriority").startswith("1"), "UNKNOWN").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("canonical_status"), F.col("o_orderdate").alias("observed_at"))
    status = status.unionByName(c.where(k % 4 == 0).select(k.alias("satellite_id"), F.lit("INACTIVE").alias("canonical_status"), F.lit(dt.datetime(2002, 1, 1)).cast("timestamp_ntz").alias("observed_at")))
    claims = o.select(F.col("o_custkey").alias("satellite_id"), F.col("o_orderpriority").alias("source"), F.explode(F.array(F.struct(F.lit("status").alias("a"), F.col("o_orderstatus").alias("v")), F.struct(F.lit("decay_date").alias("a"), F.date_format("o_orderdate", "yyyy-MM").alias("v")))).alias("x"), F.col("o_orderdate").alias("observed_at"))
    n = table(spark, d, "nation")
    value = F.max_by(F.struct("value"), F.struct("ts", -F.col("event_id")))["value"]
    days = metrics.daily(table(spark, d, "events"), "user_id", "ts", "value")
    return {
        "satellite": satellite, "status": status, "source_assertion": claims.select("satellite_id", "source", F.col("x.a").alias("attribute"), F.when(F.col("x.a") == "decay_date", F.concat("x.v", F.lit("-01"))).otherwise(F.col("x.v")).alias("value"), "observed_at"),
        "satellite_identifier": c.select(k.alias("satellite_id"), F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("i")), "merge_log": c.where("c_acctbal < 0").select(k.alias("satellite_id")), "gp_elements": table(spark, d, "events"),
        "satellite_operator": c.where(k % 7 != 0).select(k.alias("satellite_id"), F.col("c_nationkey").cast("long").alias("operator_id"), F.lit("owner").alias("role"), F.lit(dt.date(1995, 1, 1)).alias("valid_from"), F.when(k % 5 == 0, F.lit(dt.date(2003, 1, 1))).alias("valid_to")),
        "operator": n.select(F.col("n_nationkey").cast("long").alias("operator_id"), F.col("n_name").alias("canonical_name"), F.when(F.col("n_nationkey") % 4 == 0, F.lit(dt.date(2000, 1, 1))).alias("closed_on")),
        "operator_relationship": n.where("n_nationkey >= 10").select(F.col("n_nationkey").cast("long").alias("child_id"), (F.col("n_nationkey") % 10).cast("long").alias("parent_id")),
        "latest": table(spark, d, "events").groupBy(F.col("user_id").alias("norad_id")).agg(value.alias("v")).select("norad_id", F.col("v").alias("perigee_km"), (F.col("v") + 10).alias("apogee_km")),
        "daily": days.select(F.col("user_id").alias("norad_id"), "day", F.col("value_min").alias("perigee_min"), F.col("value_max").alias("apogee_max"), "value_avg"),
    }


_GRAPH = """with sat as (select c_custkey as id, case when c_custkey % 6 <> 0 then c_custkey end as norad, c_custkey % 10 <> 0 as payload, date '2000-01-01' + (c_custkey * 7 % 600)::integer as launch, c_nationkey from customer),
stat as (select o_custkey as id, case when o_orderstatus = 'F' then 'DECAYED' when o_orderpriority like '1%' then 'UNKNOWN' when o_orderstatus = 'O' then 'ACTIVE' else 'INACTIVE' end as s, o_orderdate as t from orders union all select c_custkey, 'INACTIVE', timestamp '2002-01-01' from customer where c_custkey % 4 = 0),
ls as (select id, s from (select *, row_number() over (partition by id order by t desc, s) as rn from stat) where rn = 1),
own as (select c_custkey as id, c_nationkey as op, case when c_custkey % 5 = 0 then date '2003-01-01' end as vt from customer where c_custkey % 7 <> 0),
latest as (select user_id as norad, value as perigee, value + 10 as apogee, value + 5 as alt from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1),
days as (select user_id as norad, cast(ts as date) as d, avg(value) as v, min(value) as lo, max(value) as hi from events group by 1, 2),
fleets as (select n.n_name as operator, n.n_nationkey as op from nation n union select p.n_name, c.n_nationkey from nation c join nation p on p.n_nationkey = c.n_nationkey % 10 where c.n_nationkey >= 10),
fleet as (select distinct operator, sat.* from fleets join own using (op) join sat using (id) where payload and norad is not null) """


@query(_GRAPH + """, pay as (select sat.id, s from sat left join ls using (id) where payload and coalesce(s, 'UNKNOWN') <> 'DECAYED'),
said as (select id, source, v from (select o_custkey as id, o_orderpriority as source, o_orderstatus as v, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderstatus) as rn from orders) where rn = 1)
select (select count(*) from sat)::bigint as satellites, (select count(*) from nation)::bigint as operators, (select sum(c_custkey % 3 + 1) from customer)::bigint as identifier_rows, (select count(*) from customer where c_acctbal < 0)::bigint as merge_events, (select count(*) from events)::bigint as gp_elements,
 count(*)::bigint as on_orbit_payloads, round_even(100.0::double * count(*) filter (where id in (select id from own where vt is null)) / count(*), 1)::double as operator_pct, round_even(100.0::double * count(*) filter (where s <> 'UNKNOWN') / count(*), 1)::double as status_pct, round_even(100.0::double * count(*) filter (where id % 3 >= 1) / count(*), 1)::double as multi_source_pct,
 (select count(*) from (select id from said group by 1 having count(distinct v) > 1))::bigint as status_conflicts, (select count(*) from (select o_custkey from orders group by 1 having count(distinct strftime(o_orderdate, '%Y-%m')) > 1))::bigint as decay_conflicts,
 (select count(*) from own join nation on n_nationkey = op where vt is null and n_nationkey % 4 = 0)::bigint as stale_owners from pay""")
def v44_overview(spark, d):
    """Totals, coverages of the payloads on orbit, and conflicts, in one row."""
    return reports.overview(_graph(spark, d), dt.date(2001, 8, 1))


@query(_GRAPH + """, trail as (select norad, avg((lo + hi) / 2.0) as trail from days where d > (select max(d) from days) - 14 group by 1)
select count(*)::bigint as deployed_total, count(*) filter (where s = 'DECAYED')::bigint as deorbited, count(*) filter (where coalesce(s, 'U') <> 'DECAYED' and alt between 30 and 80 and (trail is null or trail between 30 and 80))::bigint as at_shell,
 count(*) filter (where coalesce(s, 'U') <> 'DECAYED' and alt < 30)::bigint as raising, count(*) filter (where launch > date '2001-08-01' - 30)::bigint as deployed_last_30d from fleet left join latest using (norad) left join trail using (norad) left join ls using (id) where operator = 'CANADA'""".replace("'CANADA'", "(select n_name from nation where n_nationkey = 3)"))
def v39_shell_milestone(spark, d):
    """One operator's fleet and its children's against a shell."""
    name = table(spark, d, "nation").where("n_nationkey = 3").first()["n_name"]
    return reports.shell_milestone(_graph(spark, d), name, 30.0, 80.0, dt.date(2001, 8, 1))


@query(_GRAPH + "select operator, count(*)::bigint as n, round(avg(alt), 1) as avg_alt_km from fleet join ls using (id) join latest using (norad) where s = 'INACTIVE' and perigee > 20 and alt < 90 and operator in (select n_name from nation where n_nationkey < 8) group by 1 order by n desc, operator limit 6")
def v39_lingering_board(spark, d):
    """Operators with the most inactive objects that stay where they are."""
    names = [r["n_name"] for r in table(spark, d, "nation").where("n_nationkey < 8").collect()]
    return reports.lingering_board(_graph(spark, d), names, 20.0, 90.0)


@query(_GRAPH + """, m as (select *, min(d) over (partition by norad) as d0, max(d) over (partition by norad) as d1 from days),
a as (select norad, avg(v) filter (where d < d0 + 90) as f, avg(v) filter (where d > d1 - 14) as l, avg(v) filter (where d <= d1 - 14 and d > d1 - 28) as b from m group by 1)
select id as satellite_id from a join sat using (norad) join ls using (id) where s = 'ACTIVE' and l <= f - 0.5 and l < b""")
def v39_active_but_decaying(spark, d):
    """Objects said to be active that have left their first level."""
    t = _graph(spark, d)
    return reports.active_but_decaying(t["daily"], t["satellite"], t["status"], drop=0.5)


# ------------------------------------------------------------------ filings
def _filings(spark, d) -> tuple[tuple[DataFrame, ...], dict[str, DataFrame]]:
    """Filings, stations, addresses and runs; and the tables beside them."""
    o, s, c, n = (table(spark, d, x) for x in ("orders", "supplier", "customer", "nation"))
    k, on = F.col("o_orderkey"), F.to_date("o_orderdate")
    runs = spark.createDataFrame([(1, "filings", "ok"), (2, "filings", "ok"), (3, "filings", "error"), (4, "stations", "ok"), (5, "addresses", "ok")], "ingest_run_id long, source string, status string")
    gone = lambda v: F.when(F.col("o_orderstatus") == v, on)
    filings = o.select(
        k.alias("filing_key"), F.concat(F.lit("SAT"), k.cast("string")).alias("file_number"), F.concat(F.lit("s"), (F.col("o_custkey") % 120).cast("string")).alias("callsign"), F.lit("N").alias("app_type_code"), F.col("o_orderstatus").alias("status_code"), F.when(k % 17 != 0, on).alias("date_filed"), on.alias("date_last_update"),
        gone("F").alias("date_grant"), gone("P").alias("date_deny"), _none().alias("date_dismiss"), _none().alias("date_surrender"), F.when(k % 9 != 0, "SAT").otherwise("SES").alias("subsystem_code"), F.col("o_orderpriority").alias("description"), F.col("o_custkey").alias("applicant_address_key"), F.lit("own").alias("frn"), F.when(k % 4 == 0, 1).otherwise(2).cast("long").alias("ingest_run_id"),
    )
    sk = F.col("s_suppkey")
    stations = s.select(F.when(sk % 2 == 0, F.concat("s_name", F.lit(" (S"), (sk % 60).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("s"), (sk % 60).cast("string"))).alias("us_name"), F.when(sk % 3 == 0, F.col("s_name")).alias("itu_name"), (sk % 5).cast("string").alias("orbit_location"), F.lit(4).cast("long").alias("ingest_run_id"))
    addresses = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("address_key"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("f"), (F.col("c_custkey") % 40).cast("string"))).alias("frn"), F.lit(5).cast("long").alias("ingest_run_id"))
    l = table(spark, d, "lineitem")  # noqa: E741
    file = F.concat(F.lit("SAT"), F.col("l_orderkey").cast("string")).alias("file_number")
    t = {
        "applicant_link": n.select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("frn"), F.lower("n_name").alias("manufacturer_slug")), "document": l.where("l_linenumber <= 2").select(file), "note": o.where("o_orderkey % 5 = 0").select(F.concat(F.lit("SAT"), k.cast("string")).alias("file_number"), F.col("o_orderpriority").alias("summary")),
        "plane": l.select(file, (F.col("l_quantity") * 20).alias("apogee_km"), (F.col("l_quantity") * 20 - 10).alias("perigee_km"), F.col("l_discount").alias("inclination_deg"), (F.col("l_linenumber") != 3).alias("is_validated")),
        "docket": metrics.dockets(filings.where("ingest_run_id = 2"), metrics.pending(["date_grant", "date_deny"]), F.col("date_grant").isNotNull(), F.col("description").startswith("1")),
    }
    return (filings, stations, addresses, runs), t


_PENDING = """with f as (select o_orderkey as filing_key, 'SAT' || o_orderkey as file_number, 's' || o_custkey % 120 as callsign, 'N' as app_type_code, o_orderstatus as status_code, case when o_orderkey % 17 <> 0 then cast(o_orderdate as date) end as date_filed, cast(o_orderdate as date) as date_last_update, o_orderpriority as description, o_custkey, o_orderkey % 9 <> 0 as sat from orders where o_orderkey % 4 <> 0),
st as (select coalesce(nullif(regexp_extract(upper(us_name), '\\(([A-Z]+[0-9][0-9A-Z-]*)\\)', 1), ''), upper(us_name)) as k, string_agg(distinct us_name, ' / ' order by us_name) as satellite_name, string_agg(distinct itu_name, ' / ' order by itu_name) as itu_name, string_agg(distinct loc, ' / ' order by loc) as orbit_location
 from (select case when s_suppkey % 2 = 0 then s_name || ' (S' || s_suppkey % 60 || ')' else 's' || s_suppkey % 60 end as us_name, case when s_suppkey % 3 = 0 then s_name end as itu_name, (s_suppkey % 5)::varchar as loc from supplier) group by 1),
pend as (select filing_key, file_number, callsign, app_type_code, status_code, date_filed, date_last_update, satellite_name, st.itu_name, orbit_location, description, c_name as applicant_name, coalesce(case when c_custkey % 2 = 0 then 'f' || c_custkey % 40 end, 'own') as applicant_frn
 from f left join st on st.k = upper(callsign) left join (select * from customer where c_custkey % 3 <> 0) on c_custkey = o_custkey where sat and date_filed is not null and status_code not in ('F', 'P')) """


@query(_PENDING + "select * from pend")
def v19_pending_filings(spark, d):
    """Filings on which nothing is decided, with their stations and applicants."""
    return reports.pending_filings(*_filings(spark, d)[0])


@query(_PENDING + """, page as (select * from pend where callsign ilike '%s1%' or file_number ilike '%s1%' or satellite_name ilike '%s1%' or itu_name ilike '%s1%' or applicant_name ilike '%s1%' or description ilike '%s1%' order by date_filed desc nulls last, file_number, filing_key limit 40 offset 5),
spec as (select 'SAT' || l_orderkey as file_number, count(*)::bigint as spec_planes_n, round(min(l_quantity * 20 - 5) filter (where l_quantity * 20 between 150 and 50000)) as spec_alt_min_km, round(max(l_quantity * 20 - 5) filter (where l_quantity * 20 between 150 and 50000)) as spec_alt_max_km, min(l_discount) as spec_incl_min_deg, max(l_discount) as spec_incl_max_deg,
 count(*) filter (where l_quantity * 20 not between 150 and 50000)::bigint as spec_implausible_n from lineitem where l_linenumber <> 3 group by 1),
doc as (select 'SAT' || l_orderkey as file_number, count(*)::bigint as documents_n from lineitem where l_linenumber <= 2 group by 1),
dock as (select callsign, count(*) filter (where date_filed is not null and status_code not in ('F', 'P'))::bigint as docket_filings_pending, count(*)::bigint as docket_filings_total, count(*) filter (where date_filed is not null and status_code not in ('F', 'P') and description like '1%')::bigint as docket_pending_amendments from f group by 1)
select page.*, lower(n_name) as applicant_slug, coalesce(documents_n, 0)::bigint as documents_n, case when filing_key % 5 = 0 then description end as note_summary, spec_planes_n, spec_alt_min_km, spec_alt_max_km, spec_incl_min_deg, spec_incl_max_deg, spec_implausible_n, docket_filings_pending, docket_filings_total, docket_pending_amendments
from page left join nation on 'f' || n_nationkey = applicant_frn left join doc using (file_number) left join spec using (file_number) left join dock using (callsign)""")
def v21_pending_page(spark, d):
    """A page of pending filings that match a text, with everything known beside them."""
    pending, t = _filings(spark, d)
    return reports.pending_page(*pending, t, "s1", limit=40, offset=5)


@query(_PENDING + "select count(*)::bigint as total from pend where applicant_frn in (select 'f' || n_nationkey from nation where n_nationkey = 6)")
def v21_pending_total(spark, d):
    """How many one maker's group has filed."""
    slug = table(spark, d, "nation").where("n_nationkey = 6").first()["n_name"]
    pending, t = _filings(spark, d)
    return reports.pending_total(*pending, t, applicant=slug)


# ------------------------------------------------------------------ reports in pages
@query("""with recursive r as (select l_orderkey, l_linenumber, case when (l_orderkey + l_linenumber) % 3 = 0 then 'I' else 'IA' end as labels, round(l_discount * 100) as inc, l_quantity as apo, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_discount) as page from lineitem where l_orderkey % 5 = 0),
e as (select l_orderkey, page, 1 as seq, 'I' as f, inc as v from r union all select l_orderkey, page, 2, 'A', apo from r where labels = 'IA'),
n as (select *, row_number() over (partition by l_orderkey order by page, seq) as i from e),
w as (select l_orderkey, i, page, f, v, [f] as has, 0 as block from n where i = 1 union all select n.l_orderkey, n.i, n.page, n.f, n.v, case when list_contains(w.has, n.f) then [n.f] else list_append(w.has, n.f) end, w.block + list_contains(w.has, n.f)::integer from w join n on n.l_orderkey = w.l_orderkey and n.i = w.i + 1)
select l_orderkey, block::integer as block, min(page)::integer as source_page, max(v) filter (where f = 'I') as inclination_deg, max(page) filter (where f = 'I')::integer as inclination_deg_page, max(v) filter (where f = 'A') as apogee_km, max(page) filter (where f = 'A')::integer as apogee_km_page from w group by 1, 2""")
def v34_form_blocks(spark, d):
    """Repeated labelled blocks of paged reports, each field with its page: reports made from order lines, a page each."""
    inc, apo = F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.col("l_quantity").cast("string")
    both = F.concat(F.lit("Inclination Angle "), inc, F.lit("\nother 5\nApogee "), apo)
    line = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, F.concat(F.lit("Inclination Angle "), inc)).otherwise(both)
    pages = table(spark, d, "lineitem").where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", line.alias("t")))), lambda s: s["t"]).alias("pages"))
    return documents.labelled_groups(pages, "l_orderkey", r"(Inclination Angle|Apogee) ([\d.]+)", {"Inclination Angle": "inclination_deg", "Apogee": "apogee_km"})


@query("""select p_partkey, regexp_matches(' ' || p_retailprice::varchar || 'a x12.0 ' || p_size || '.5 ', '[^0-9.]' || p_size || '(\\.0)?[^0-9.]') as whole, regexp_matches(' ' || p_name || ' 7' || (p_size + 0.5)::varchar || ' ', '[^0-9.]' || replace((p_size + 0.5)::varchar, '.', '\\.') || '[^0-9.]') as part from part""")
def v34_number_support(spark, d):
    """Whether numbers stand on a page as tokens of their own."""
    size = F.col("p_size").cast("string")
    a = F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit("a x12.0 "), size, F.lit(".5 "))
    b = F.concat(F.lit(" "), "p_name", F.lit(" 7"), (F.col("p_size") + 0.5).cast("string"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", text.page_supports_number(a, F.col("p_size")).alias("whole"), text.page_supports_number(b, F.col("p_size") + 0.5).alias("part"))


# ------------------------------------------------------------------ gold cases
def _gold(spark, d) -> dict[str, DataFrame]:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("c_custkey")
    pick = lambda m, *options: F.element_at(F.array(*(F.lit(o) for o in options)), (k % m + 1).cast("int"))
    day = F.date_add(F.lit(dt.date(1980, 1, 1)), (k * 37 % 12000).cast("int"))
    satellite = c.select(k.alias("satellite_id"), F.when(k % 6 != 0, k).alias("norad_id"), F.lower("c_name").alias("canonical_name"), F.when(k % 10 != 0, "PAYLOAD").otherwise("DEBRIS").alias("object_type"), F.when(k % 11 != 0, day).alias("launch_date"))
    owner = lambda shift: F.concat(F.lit(" N"), ((F.col("c_nationkey") + shift) % 25).cast("string"))
    said = {
        "satcat": {"owner": owner(0), "status": pick(3, "+", "-", "?"), "decay_date": F.date_format(day, "yyyy-MM-dd"), "object_type": F.when(k % 7 == 0, "DEB").otherwise("PAY")},
        "gcat": {"owner": owner(F.when(k % 4 == 0, 1).otherwise(0)), "status": pick(5, "O", "R", "O", "O", "?"), "decay_date": F.when(k % 8 == 0, "?").otherwise(F.date_format(F.date_add(day, F.when(k % 9 == 0, (k % 700).cast("int")).otherwise(0)), "yyyy MMM dd")), "object_type": F.lit("P")},
    }
    claims = None
    for source, attributes in said.items():
        rows = c.where(k % 12 != 0) if source == "satcat" else c
        for attribute, value in attributes.items():
            new = rows.select(k.alias("satellite_id"), F.lit(source).alias("source"), F.lit(attribute).alias("attribute"), value.alias("value"), F.lit(dt.datetime(2024, 1, 2)).alias("observed_at"), F.lit(2).cast("long").alias("ingest_run_id"), k.cast("string").alias("source_key"))
            old = new.withColumn("value", F.lit("old")).withColumn("observed_at", F.lit(dt.datetime(2024, 1, 1)))
            claims = new.unionByName(old) if claims is None else claims.unionByName(new).unionByName(old)
    key = F.col("n_nationkey").cast("long")
    words = [("satcat", "+", "ACTIVE"), ("satcat", "-", "INACTIVE"), ("satcat", "?", "UNKNOWN"), ("gcat", "O", "ACTIVE"), ("gcat", "R", "DECAYED"), ("gcat", "?", "UNKNOWN")]
    own = c.select(k.alias("satellite_id"), F.col("c_nationkey").cast("long").alias("operator_id"), F.lit("owner").alias("role"), F.when(k % 3 == 0, F.lit(dt.date(2015, 5, 5))).alias("valid_to"))
    after = c.where(k % 3 == 0).select(k.alias("satellite_id"), (F.col("c_nationkey") % 10).cast("long").alias("operator_id"), F.lit("owner").alias("role"), F.lit(None).cast("date").alias("valid_to"))
    return {
        "satellite": satellite, "source_assertion": claims, "status_mapping": spark.createDataFrame(words, "source string, value string, canonical_status string"), "satellite_operator": own.unionByName(after), "size": c.select(k.alias("norad_id"), (k % 50).cast("double").alias("rcs")),
        "satellite_identifier": c.select(k.alias("satellite_id"), F.lit("cospar").alias("id_type"), F.concat(F.lit("c"), (k % 1000).cast("string")).alias("id_value")).unionByName(c.where(k % 2 == 0).select(k.alias("satellite_id"), F.lit("jcat").alias("id_type"), F.concat(F.lit("J"), k.cast("string")).alias("id_value"))),
        "operator": n.select(key.alias("operator_id"), F.col("n_name").alias("canonical_name"), F.when(key % 5 != 0, "commercial").otherwise("state").alias("operator_class")), "operator_alias": n.select(F.concat(F.lit("n"), key.cast("string")).alias("alias"), key.alias("operator_id")),
        "operator_relationship": n.where("n_nationkey >= 10").select(key.alias("child_id"), (key % 10).alias("parent_id"), F.when(key % 2 == 0, "acquired_by").otherwise("subsidiary_of").alias("relationship")).unionByName(spark.createDataFrame([(7, 6, "subsidiary_of")], "child_id long, parent_id long, relationship string")),
    }


@query("""with s as (select c_custkey as id, case when c_custkey % 6 <> 0 then c_custkey end as norad, lower(c_name) as name, c_custkey % 10 <> 0 as payload, date '1980-01-01' + (c_custkey * 37 % 12000)::integer as day, case when c_custkey % 11 <> 0 then date '1980-01-01' + (c_custkey * 37 % 12000)::integer end as launch, c_nationkey as n1, (c_nationkey + case when c_custkey % 4 = 0 then 1 else 0 end) % 25 as n2, c_custkey % 12 <> 0 as inboth from customer),
r as (select *, case when norad is not null then 'norad:' || norad when id % 2 = 0 then 'jcat:J' || id else 'sat:' || id end as ref from s),
rel as (select n_nationkey as c, n_nationkey % 10 as p from nation where n_nationkey >= 10 union all select 7, 6),
pairs as (select a.id as pid, b.id as cid, round(1 - levenshtein(replace(a.name, '#', ' '), replace(b.name, '#', ' ')) / greatest(length(a.name), length(b.name)), 4) as sim from s a join s b on abs(a.launch - b.launch) <= 30 where a.norad is null and b.norad is not null),
best as (select * from (select *, row_number() over (partition by pid order by sim desc, cid) as rn from pairs where sim >= 0.75) where rn = 1 order by sim desc, pid limit 30)
select 'ambiguous_cospar' as case_type, null::bigint as satellite_id, 'cospar:c' || c_custkey % 1000 as subject_ref from customer group by c_custkey % 1000 having count(*) > 1
union all select 'rideshare_orphan', id, ref from r where norad is null and payload and not inboth
union all select 'missed_join_candidate', pid, ref from best join r on r.id = pid
union all select * from (select 'owner_dispute', id, ref from r where inboth and n1 <> n2 and n1 % 5 <> 0 and n2 % 5 <> 0 and not exists (select 1 from rel where (c = n1 and p = n2) or (c = n2 and p = n1)) order by case when norad is not null then id % 50 end desc nulls last, norad nulls last, id limit 30)
union all select 'status_conflict', id, ref from r where inboth and id % 3 <> 2 and id % 5 <> 4 and (case id % 3 when 0 then 'ACTIVE' else 'INACTIVE' end) <> (case id % 5 when 1 then 'DECAYED' else 'ACTIVE' end)
union all select * from (select 'decay_conflict', id, ref from r where inboth and id % 8 <> 0 and id % 9 = 0 and id % 700 > 0 order by id % 700 desc, id limit 20)
union all select * from (select 'type_conflict', id, ref from (select *, coalesce(extract(year from launch) // 10 * 10, -1) as dec, row_number() over (partition by coalesce(extract(year from launch) // 10 * 10, -1) order by norad nulls last, id) as rn from r where inboth and id % 7 = 0) order by rn, dec limit 25)
union all select * from (select 'stale_owner', id, ref from (select *, row_number() over (partition by n1 order by norad nulls last, id) as rn from r where id % 3 = 0 and n1 >= 10 and n1 % 2 = 0) order by rn, n1 limit 15)""")
def v35_gold_cases(spark, d):
    """Hard cases of all eight strata; names are compared by edit distance, which both engines have."""
    return gold.gold_cases(_gold(spark, d), measure="edit").select("case_type", "satellite_id", "subject_ref")


# ------------------------------------------------------------------ behaviour report
def _behaviour(spark, d) -> dict[str, DataFrame]:
    """The graph with elements at heights that the report asks about: customers' orders as days of descent."""
    t = _graph(spark, d)
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k, p = F.col("c_custkey"), F.col("o_totalprice")
    sat = c.select(k.alias("satellite_id"), k.alias("norad_id"), F.when(k % 10 != 0, "PAYLOAD").otherwise("DEBRIS").alias("object_type"), F.when(k % 2 == 0, F.date_add(F.lit(dt.date(2001, 1, 1)), (k % 900).cast("int"))).alias("decay_date"))
    days = o.groupBy(F.col("o_custkey").alias("norad_id"), F.to_date("o_orderdate").alias("day")).agg((F.min(p) / 400).alias("perigee_min"), (F.max(p) / 400 + 20).alias("apogee_max"))
    return t | {"satellite": sat, "daily": days, "latest": c.select(k.alias("norad_id"), (F.lit(35_000.0) + (k * 7 % 1500)).alias("perigee_km"), (F.lit(35_400.0) + (k * 11 % 1500)).alias("apogee_km"))}


_BEHAVIOUR = """with stat as (select o_custkey as id, case when o_orderstatus = 'F' then 'DECAYED' when o_orderpriority like '1%' then 'UNKNOWN' when o_orderstatus = 'O' then 'ACTIVE' else 'INACTIVE' end as s, o_orderdate as t from orders union all select c_custkey, 'INACTIVE', timestamp '2002-01-01' from customer where c_custkey % 4 = 0),
ls as (select id, s from (select *, row_number() over (partition by id order by t desc, s) as rn from stat) where rn = 1),
own as (select c_custkey as id, n_name as operator from customer join nation on n_nationkey = c_nationkey where c_custkey % 7 <> 0 and c_custkey % 5 <> 0),
pay as (select c_custkey as id, case when c_custkey % 2 = 0 then date '2001-01-01' + (c_custkey % 900)::integer end as decay, 35000.0::double + c_custkey * 7 % 1500 as perigee, 35400.0::double + c_custkey * 11 % 1500 as apogee, operator, s from customer join ls on id = c_custkey join own using (id) where c_custkey % 10 <> 0),
days as (select o_custkey as id, cast(o_orderdate as date) as d, min(o_totalprice) / 400 as lo, (min(o_totalprice) / 400 + max(o_totalprice) / 400 + 20) / 2 as alt from orders group by 1, 2),
gone as (select days.*, operator, decay from days join pay using (id) where s = 'DECAYED' and decay between date '2001-02-01' and date '2003-01-01'),
shell as (select id, quantile_cont(alt, 0.9) as shell, arg_max(lo, d) as last_perigee from gone group by 1),
per as (select id, operator, shell, last_perigee, decay - max(d) as descent from gone join shell using (id) where alt >= shell - 30 group by id, operator, shell, last_perigee, decay) """


@query(_BEHAVIOUR + "select operator, count(*)::bigint as reentries, round(quantile_cont(last_perigee, 0.5), 1) as median_final_perigee_km, round(quantile_cont(shell, 0.5)) as median_op_shell_km, round(quantile_cont(descent, 0.5))::double as median_descent_days from per group by 1")
def v38_reentry_descent(spark, d):
    """How fast each operator's objects came down from their shell."""
    return reports.reentry_descent(_behaviour(spark, d), dt.date(2001, 2, 1), dt.date(2003, 1, 1))


@query(_BEHAVIOUR + """, g as (select *, (perigee + apogee) / 2 as alt from pay where s = 'INACTIVE' and (perigee + apogee) / 2 between 34000 and 38000 and apogee > 34500)
select operator, count(*)::bigint as inactive_geo, count(*) filter (where perigee >= 36021)::bigint as graveyard_compliant, count(*) filter (where perigee < 36021 and alt between 35586 and 35986)::bigint as abandoned_in_belt, round(quantile_cont(perigee - 35786, 0.5)) as median_perigee_above_geo_km from g group by 1 having count(*) >= 3""")
def v38_geo_end_of_life(spark, d):
    """What became of the inactive objects near the belt."""
    return reports.geo_end_of_life(_behaviour(spark, d))


@query(_BEHAVIOUR + """, i as (select operator, count(*) as n, count(*) filter (where apogee < 36500 and perigee > 35500) as l, round(avg((perigee + apogee) / 2) filter (where apogee < 36500 and perigee > 35500), 1) as a from pay where s = 'INACTIVE' group by 1),
r as (select operator, count(*)::bigint as n, round(quantile_cont(last_perigee, 0.5), 1) as p, round(quantile_cont(shell, 0.5)) as sh, round(quantile_cont(descent, 0.5))::double as de from per group by 1)
select n_name as operator, coalesce(i.n, 0)::bigint as inactive_payloads, coalesce(l, 0)::bigint as lingering, a as lingering_avg_alt_km, coalesce(r.n, 0)::bigint as reentries, p as median_final_perigee_km, sh as median_op_shell_km, de as median_descent_days from nation left join i on i.operator = n_name left join r on r.operator = n_name where n_nationkey < 12""")
def v38_disposal_board(spark, d):
    """What each operator leaves up and brings down."""
    names = [r["n_name"] for r in table(spark, d, "nation").where("n_nationkey < 12").collect()]
    return reports.disposal_board(_behaviour(spark, d), names, dt.date(2001, 2, 1), dt.date(2003, 1, 1), 35_500.0, 36_500.0)


@query(_GRAPH + """, said as (select c_custkey as id, 'n' || c_nationkey as v from customer where c_custkey % 12 <> 0)
select p.n_name as acquirer, c.n_name as catalog_still_names, date '2000-01-01' + c.n_nationkey as acquired_on, count(*)::bigint as attributed_objects, count(*) filter (where coalesce(s, '') <> 'DECAYED')::bigint as on_orbit
from said join nation c on 'n' || c.n_nationkey = v join nation p on p.n_nationkey = c.n_nationkey % 10 left join ls using (id) where c.n_nationkey >= 10 and c.n_nationkey % 2 = 0 group by 1, 2, 3""")
def v38_accountability(spark, d):
    """Objects that a catalogue still gives to operators that were bought."""
    t, g = _graph(spark, d), _gold(spark, d)
    deals = g["operator_relationship"].withColumn("valid_from", F.date_add(F.lit(dt.date(2000, 1, 1)), F.col("child_id").cast("int"))).withColumn("valid_to", _none())
    claims = g["source_assertion"].withColumn("value", F.trim("value"))
    return reports.stale_attributions(t | {"source_assertion": claims, "operator": g["operator"], "operator_alias": g["operator_alias"], "operator_relationship": deals}, "satcat", dt.date(2001, 1, 1))


@query("""with ids as (select case when c_custkey % 3 = 0 then 'norad' else 'cospar' end as t, c_custkey % 8 = 0 as closed from customer)
select 'identifiers' as figure, t as key, count(*)::bigint as n from ids group by 1, 2 union all select 'closed', t, count(*) from ids where closed group by 1, 2 union all select 'links', 'r' || o_custkey % 3, count(*) from orders group by 1, 2 union all select 'events', o_orderpriority, count(*) from orders group by 1, 2
union all select 'unmatched', s_nationkey::varchar, count(distinct s_name) from supplier where s_suppkey % 2 = 0 group by 1, 2 union all select 'entities', 'provisional', count(*) from customer where c_custkey % 6 = 0""")
def v37_identity_figures(spark, d):
    """The quality report's counts of identifiers, links, events and what is unmatched."""
    c, o, s = (table(spark, d, x) for x in ("customer", "orders", "supplier"))
    k = F.col("c_custkey")
    return reports.identity_figures({
        "satellite_identifier": c.select(F.when(k % 3 == 0, "norad").otherwise("cospar").alias("id_type"), F.when(k % 8 == 0, F.lit(dt.date(2020, 1, 1))).alias("valid_to")), "merge_log": o.select(F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("rule")),
        "identity_event": o.select(F.col("o_orderpriority").alias("event")), "satellite": c.select(F.when(k % 6 == 0, "provisional").otherwise("anchored").alias("anchor_state")),
        "source_assertion": s.select(F.when(F.col("s_suppkey") % 2 != 0, F.col("s_suppkey")).alias("satellite_id"), F.col("s_nationkey").alias("source"), F.col("s_name").alias("source_key")),
    })


@query("""with st as (select o_custkey as id, case o_orderstatus when 'F' then 'DECAYED' when 'O' then 'ACTIVE' else 'INACTIVE' end as s, o_orderdate as t from orders), ls as (select id, s from (select *, row_number() over (partition by id order by t desc, s) as rn from st) where rn = 1),
b as (select user_id, count(*)::bigint as gp_days, max(value) as top from events group by 1)
select c_custkey as satellite_id, norad_id, c_name as canonical_name, coalesce(s, 'UNKNOWN') as canonical_status, 'b' || c_custkey % 9 as bus_slug, 'm' || c_nationkey as manufacturer_slug, 'r' || c_custkey % 3 as join_rule, gp_days, top,
 case when s = 'DECAYED' and decay >= launch then (decay - launch)::integer end as lifetime_days, c_custkey % 31 = 0 or coalesce(norad_id in (select c_custkey from customer where c_custkey % 17 = 0), false) as key_churn_observed
from (select *, case when c_custkey % 6 <> 0 then c_custkey end as norad_id, date '2000-01-01' + (c_custkey * 7 % 600)::integer as launch, case when c_custkey % 3 = 0 then date '2001-01-01' + (c_custkey % 500)::integer end as decay from customer where c_custkey % 4 <> 1) left join ls on id = c_custkey left join b on user_id = norad_id""")
def v13_entity_view(spark, d):
    """The per-entity product view as a program of the library."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k = F.col("c_custkey")
    tag = lambda a, v: F.concat(F.lit(a), v.cast("string"))
    return reports.entity_products({
        "satellite": c.select(k.alias("satellite_id"), F.when(k % 6 != 0, k).alias("norad_id"), F.col("c_name").alias("canonical_name"), F.date_add(F.lit(dt.date(2000, 1, 1)), (k * 7 % 600).cast("int")).alias("launch_date"), F.when(k % 3 == 0, F.date_add(F.lit(dt.date(2001, 1, 1)), (k % 500).cast("int"))).alias("decay_date")),
        "satellite_bus": c.where(k % 4 != 1).select(k.alias("satellite_id"), tag("b", k % 9).alias("bus_slug"), tag("m", F.col("c_nationkey")).alias("manufacturer_slug"), tag("r", k % 3).alias("join_rule")),
        "status": o.select(F.col("o_custkey").alias("satellite_id"), F.when(F.col("o_orderstatus") == "F", "DECAYED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("canonical_status"), F.col("o_orderdate").alias("observed_at")),
        "behaviour": table(spark, d, "events").groupBy(F.col("user_id").alias("norad_id")).agg(F.count(F.lit(1)).alias("gp_days"), F.max("value").alias("top")),
        "churn": c.where((k % 31 == 0) | (k % 17 == 0)).select(F.when(k % 31 == 0, k).alias("satellite_id"), F.when(k % 17 == 0, k).alias("norad_id")),
    })


# ------------------------------------------------------------------ the query layer
def _engine(spark, d):
    from .api import Engine

    t = _graph(spark, d)
    ids = t["satellite"].withColumn("canonical_name", F.concat(F.lit("SAT "), F.col("satellite_id").cast("string"))).withColumn("cospar", F.lit(None).cast("string"))
    elements = table(spark, d, "events").select(F.col("user_id").alias("norad_id"), F.col("ts").alias("epoch"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("source"), (F.col("value") * 10).alias("perigee_km"), (F.col("value") * 10 + 10).alias("apogee_km"), (F.col("value") % 90).alias("inclination"))
    status = t["status"].withColumn("source", F.lit("s"))
    return Engine(t | {"satellite": ids, "elements": elements, "status": status, "daily": t["daily"].withColumn("sma_avg", F.col("value_avg"))})


_NEWEST = """, el as (select user_id as norad, value * 10 as pe, value * 10 + 10 as ap, value % 90 as inc from (select *, row_number() over (partition by user_id order by ts desc, lpad(event_id::varchar, 12, '0')) as rn from events) where rn = 1) """


@query(_GRAPH + _NEWEST + "select satellite_id, norad_id, canonical_status, operator_id, perigee_km, regime from (select id as satellite_id, norad as norad_id, s as canonical_status, case when vt is null then op end::bigint as operator_id, pe as perigee_km, case when pe is null or ap is null then 'UNKNOWN' when ap < 2000 then 'LEO' when pe < 2000 then 'HEO' else 'MEO' end as regime from sat left join ls using (id) left join own using (id) left join el using (norad)) where satellite_id = 37")
def v41_card(spark, d):
    """One entity with its newest status, owner and elements."""
    return _engine(spark, d).query("detail", satellite_id=37).select("satellite_id", "norad_id", "canonical_status", "operator_id", "perigee_km", "regime")


@query(_GRAPH + _NEWEST + "select cast(floor((pe + ap) / 2 / 50) * 50 as integer) as x_bin, cast(floor(inc / 5) * 5 as integer) as y_bin, count(*)::bigint as object_count from el where (pe + ap) / 2 < 700 group by 1, 2")
def v7_congestion(spark, d):
    """Objects by height and inclination, from the newest elements."""
    return _engine(spark, d).query("congestion", max_km=700.0)


@query("""select bucket::bigint as bucket, list_sort(list(d))[len(list(d)) // 2 + 1] as "day", round(avg(v), 9) as sma_avg from (select *, ((r + 1) * least(n, 7) - 1) // n as bucket from (select cast(ts as date) as d, avg(value) as v, row_number() over (order by cast(ts as date)) - 1 as r, count(*) over () as n from events where user_id = 5 group by 1)) group by 1""")
def v41_track(spark, d):
    """An object's series in a few points."""
    e = _engine(spark, d)
    e.tables["daily"] = e.tables["daily"].withColumn("elset_count", F.lit(1))
    return r9(e.query("track", norad_id=5, points=7).select("bucket", "day", "sma_avg"), "sma_avg")


@query("""with b as (select c_mktsegment as slug, count(*)::bigint as n from customer group by 1) select '2024-01' as "month", slug, n from b where slug = 'BUILDING' union all select '2024-02', slug, n + 1 from b where slug = 'BUILDING'""")
def v43_history(spark, d):
    """What was frozen of a product, month by month, by a name it no longer has."""
    from ..operators import mutations
    from .api import Engine

    board = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    none = spark.createDataFrame([], "month string, kind string, slug string, payload string")
    frozen = mutations.freeze_month(mutations.freeze_month(none, board, "2024-01", "bus"), board.withColumn("n", F.col("n") + 1), "2024-02", "bus")
    alias = spark.createDataFrame([("bus", "old-building", "BUILDING")], "kind string, old_slug string, new_slug string")
    got = Engine({"product": board, "slug_alias": alias, "bus_snapshot": frozen, "elements": board}).query("history", slug="old-building")
    return got.select("month", "slug", F.get_json_object("payload", "$.n").cast("long").alias("n"))


@query("select o_orderpriority as case_type, o_orderkey::varchar as subject_ref, case when o_orderkey = (select min(o_orderkey) from orders) then 'partial' when o_orderstatus = 'O' then 'correct' end as verdict from orders")
def v45_recorded_verdict(spark, d):
    """A verdict put on one case; all others are as they were."""
    from .api import Engine

    o = table(spark, d, "orders")
    cases = o.select(F.col("o_orderpriority").alias("case_type"), F.col("o_orderkey").cast("string").alias("subject_ref"), F.when(F.col("o_orderstatus") == "O", "correct").alias("verdict"))
    one = o.orderBy("o_orderkey").select("o_orderpriority", "o_orderkey").first()
    return Engine({"gold_case": cases, "elements": cases}).record_verdict(one[0], str(one[1]), "partial", dt.datetime(2024, 1, 1))


@query("with c as (select o_orderpriority as case_type, o_orderkey::varchar as subject_ref from orders where o_orderstatus = 'P') select * from c where (case_type, subject_ref) > ('2-HIGH', '5') order by 1, 2 limit 10")
def v45_next_cases(spark, d):
    """The open cases behind a given one."""
    from .api import Engine

    cases = table(spark, d, "orders").select(F.col("o_orderpriority").alias("case_type"), F.col("o_orderkey").cast("string").alias("subject_ref"), F.when(F.col("o_orderstatus") != "P", "correct").alias("verdict"), F.lit("{}").alias("evidence"))
    return Engine({"gold_case": cases, "elements": cases}).query("review", after=("2-HIGH", "5"), limit=10).select("case_type", "subject_ref")
