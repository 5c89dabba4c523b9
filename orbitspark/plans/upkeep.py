"""Queries over what keeps tables up to date: incremental rollups, state that ends, committed runs, workbooks, merges to the end of
their chains."""

from __future__ import annotations

import io
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import mutations, selection
from ..operators.relational import latest_per_key
from ..operators.written import shared_folder
from ..sources import workbook
from ..sources.runs import Runs
from ..streaming import rollup, state
from ..streaming.materialise import Materialised
from .standins import query, table


def _daily(facts):
    days = facts.groupBy("user_id", F.to_date("ts").alias("day"))
    return days.agg(F.round(F.avg("value"), 9).alias("value_avg"), F.max("value").alias("value_max"), F.count(F.lit(1)).alias("n"))


@query("""select user_id, cast(ts as date) as "day", round(avg(value), 9) as value_avg, max(value) as value_max, count(*) as n from events group by 1, 2""")
def st1_incremental_rollup(spark, d):
    """Events land in three batches: by far the most, then errors, which touch old days again, then clicks that are not refreshed and so
    are computed when read. What is committed and what is pending make up the batch rollup."""
    e = table(spark, d, "events")
    kept = Materialised(spark, shared_folder(spark, "rollup"), e.schema, "ts", _daily)
    kept.land(e.where("event_type not in ('error', 'click') or event_type is null"), 0)
    kept.refresh()
    kept.land(e.where("event_type = 'error'"), 1)
    kept.refresh()
    kept.land(e.where("event_type = 'click'"), 2)
    return kept.current().select("user_id", "day", "value_avg", "value_max", "n")


@query("select user_id, ts, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1")
def st4_latest_that_ends(spark, d):
    """Latest row of each key from a stateful stream whose idle keys are forgotten; the newest change of each key is its latest row."""
    e = table(spark, d, "events")
    stream = rollup.timed(spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*"), "ts", "60 days")
    changes, _ = state.run_into_log(state.latest(stream, "user_id", "ts", "event_id", ["value"], "90 days"))
    return latest_per_key(changes, ["user_id"], [F.col("ts").desc(), F.col("event_id").asc()]).select("user_id", "ts", "event_id", "value")


@query("""select o_orderkey, o_orderstatus, case o_orderstatus when 'F' then 1 else 2 end as nth, true as newest from orders where o_orderstatus = 'P'
union all select o_orderkey, o_orderstatus, 1, false from orders where o_orderstatus = 'F'""")
def k1_committed_runs(spark, d):
    """Three pulls of one table: the first lands, the second fails half way through its rows, the third lands. Only the rows of closed
    runs are read; `nth` numbers the runs that are read, in order, and `newest` marks the last."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    runs = Runs(spark, shared_folder(spark, "runs"))
    pull = lambda status, rows=o: lambda: rows.where(F.col("o_orderstatus") == status)
    runs.land("made", "orders/F", "orders", pull("F"))
    broken = o.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 100 == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("o_orderkey")))
    try:
        runs.land("made", "orders/O", "orders", pull("O", broken))
    except Exception as e:
        if "bad row" not in str(e):
            raise
    runs.land("made", "orders/P", "orders", pull("P"))
    rows = runs.committed("orders", o.schema)
    closed = runs.runs().where("status = 'ok'").select("ingest_run_id", F.row_number().over(Window.orderBy("ingest_run_id")).alias("nth"))  # a row a run
    newest = runs.newest("orders", o.schema).select("o_orderkey", F.lit(True).alias("newest"))
    return rows.join(closed, "ingest_run_id").join(newest, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "nth", F.coalesce("newest", F.lit(False)).alias("newest"))


_MERGED = """with recursive pairs as (
    select c_custkey as m, c_custkey - 1 as s from customer where (c_custkey // 400) % 2 = 0 and c_custkey % 40 > 0
    union all select c_custkey, case when c_custkey % 5 = 4 then c_custkey - 4 else c_custkey + 1 end from customer where (c_custkey // 400) % 2 = 1 and c_custkey // 5 * 5 + 4 <= (select max(c_custkey) from customer)),
walk as (select m, s as fin, least(m, s) as low, 1 as n from pairs union all select walk.m, pairs.s, least(low, pairs.s), n + 1 from walk join pairs on pairs.m = walk.fin where n < 45),
ends as (select m, fin, low, n, fin in (select m from pairs) as cyc from walk qualify row_number() over (partition by m order by n desc) = 1),
final as (select m, case when cyc then low else fin end as s, cyc from ends where m <> case when cyc then low else fin end),
o as (select coalesce(s, o_custkey) as k, o_orderkey, o_orderpriority, s is not null as moved from orders left join final on m = o_custkey)"""


@query(
    _MERGED
    + """
select 'facts' as child, k as satellite_id, count(*) as n, sum(o_orderkey) as keys from o group by k
union all select 'named', k, count(*), sum(o_orderkey) from (select * from o qualify row_number() over (partition by k, o_orderpriority order by moved, o_orderkey) = 1) group by k
union all select 'self', k, count(*), sum(kk) from (select coalesce(s, c_custkey) as k, c_custkey as kk from customer left join final on m = c_custkey) group by k
union all select 'log ' || case when cyc then 'cycle' else 'merge' end, s, count(*), sum(coalesce(n, 0)) from final left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = m group by s, cyc"""
)
def u6_merge_closure(spark, d):
    """Customers merged in chains of 39 links and in cycles of five; three tables that refer to them follow to the end, with the log."""
    c, o, k = table(spark, d, "customer"), table(spark, d, "orders"), F.col("c_custkey")
    last = c.agg(F.max("c_custkey")).first()[0]
    chain = c.where((F.floor(k / 400) % 2 == 0) & (k % 40 > 0)).select(k.alias("merged_id"), (k - 1).alias("surviving_id"))
    ring = c.where((F.floor(k / 400) % 2 == 1) & (F.floor(k / 5) * 5 + 4 <= last)).select(k.alias("merged_id"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("surviving_id"))
    facts = o.select(F.col("o_custkey").alias("satellite_id"), "o_orderkey", "o_orderpriority")
    children = {"facts": (facts, None), "named": (facts.select("satellite_id", "o_orderpriority", "o_orderkey"), ["satellite_id", "o_orderpriority"]), "self": (c.select(k.alias("satellite_id"), k.alias("o_orderkey")), None)}
    moved, log = mutations.merge_all(children, chain.union(ring))
    sums = [df.groupBy("satellite_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).select(F.lit(name).alias("child"), "satellite_id", "n", "keys") for name, df in moved.items()]
    logged = log.where("child = 'facts'").groupBy(F.concat(F.lit("log "), "rule").alias("child"), F.col("surviving_id").alias("satellite_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("moved").alias("keys"))
    return reduce(DataFrame.unionByName, [*sums, logged])


def _workbook(pdf: pd.DataFrame) -> pd.DataFrame:
    """A workbook of one nation's suppliers: a title, a header, a row each; names inline, balances as numbers, days as serial dates."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    rows = [text("A1", "Suppliers & others"), "".join(text(f"{c}3", v) for c, v in zip("ABD", ("Call Sign", "Satellite Name", "In-orbit date"), strict=True)) + text("E3", "Balance")]
    lines = [(1, rows[0]), (3, rows[1])]
    for i, r in enumerate(pdf.sort_values("s_suppkey").itertuples(), 4):
        name = text(f"B{i}", r.s_name) if r.s_suppkey % 3 else ""
        lines.append((i, f'<c r="A{i}"><v>{r.s_suppkey}</v></c>{name}<c r="D{i}" s="1"><v>{36526 + r.s_suppkey % 400}</v></c><c r="E{i}"><v>{r.s_acctbal!r}</v></c>'))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="list" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/list.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/list.xml", f"<worksheet {space}><sheetData>" + "".join(f'<row r="{i}">{x}</row>' for i, x in lines) + "</sheetData></worksheet>")
    return pd.DataFrame({"path": [f"nation-{pdf.s_nationkey.iloc[0]}.xlsx"], "content": [out.getvalue()]})


@query("""select 'nation-' || s_nationkey || '.xlsx' as path, s_suppkey::varchar as call_sign, case when s_suppkey % 3 > 0 then s_name end as name,
strftime(date '2000-01-01' + (s_suppkey % 400)::integer, '%Y-%m-%d') as since, s_acctbal as balance from supplier""")
def s12_workbooks(spark, d):
    """A workbook for each nation, read cell by cell; the rows below each header, columns by place."""
    files = table(spark, d, "supplier").groupBy("s_nationkey").applyInPandas(_workbook, "path string, content binary")
    rows = workbook.sheet_rows(files, "list").where("row > 3")
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select("path", cell(0).alias("call_sign"), cell(1).alias("name"), cell(3).alias("since"), cell(4).cast("double").alias("balance"))


@query("""select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice, 0.5), 6) as p50, round(quantile_cont(l_extendedprice, 0.9), 6) as p90, round(quantile_cont(l_extendedprice, 0.999), 6) as p999
from lineitem group by 1""")
def a4_large_groups(spark, d):
    """Percentiles of groups that are sorted across tasks, as they are beyond a million values; here from 500 on."""
    found = selection.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p999": 0.999}, 500)
    return found.withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p999")})
