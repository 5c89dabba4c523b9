"""Queries over the readers, sinks and small functions: the driver's tables are written out in a source's format into the shared
folder, read back by the library, and compared with SQL over the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, orbit
from ..operators import compare, mutations, relational
from ..operators.written import shared_folder
from ..sources import delimited, documents, ledger, records
from ..streaming import rollup
from . import identity, metrics, reports
from .standins import query, table


def _lines(df: DataFrame, *rows, end: str | None = None, head: str | None = None) -> str:
    """Write one string column as a text file below a new folder, with a header line if asked, and return its path."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "landing")
    out = df.select(F.concat(*rows).alias("value"))
    if head is not None:
        first = spark.createDataFrame([(head, 0)], "value string, _o int")
        out = first.unionByName(out.withColumn("_o", F.lit(1))).coalesce(1).sortWithinPartitions("_o").select("value")
    out.write.options(**({"lineSep": end} if end else {})).text(path)
    return path


def _s(c) -> F.Column:
    return F.col(c).cast("string")


# ------------------------------------------------------------------ delimited files
def _supplier_csv(spark, d) -> str:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    day = F.when(k % 7 == 0, "soon").otherwise(F.date_format(F.date_add(F.lit(dt.date(2000, 1, 1)), (k % 400).cast("int")), "yyyy-MM-dd"))
    return _lines(s, F.lit(" "), _s("s_suppkey"), F.lit(","), F.col("s_name"), F.lit(","), F.when(k % 5 == 0, "n/a").otherwise((k * 3).cast("string")), F.lit(","), day, F.when(k % 2 == 0, "").otherwise(",cut"), head="Supp Key,S-Name,Bal,Since Day,Unused")


@query("select s_suppkey as supp_key, s_name, case when s_suppkey % 5 <> 0 then s_suppkey * 3.0 end::double as bal, case when s_suppkey % 7 <> 0 then date '2000-01-01' + (s_suppkey % 400)::integer end as since_day, null::varchar as absent from supplier")
def s1_catalogue_csv(spark, d):
    """A CSV by its header's names, cells cast with tolerance, an absent column null."""
    kinds = {"supp_key": "long", "s_name": "string", "bal": "double", "since_day": "date", "absent": "string"}
    return delimited.read_catalogue_csv(spark, _supplier_csv(spark, d), kinds)


@query("select 'supp_key' as \"column\", 0::bigint as bad union all select 'bal', count(*) filter (where s_suppkey % 5 = 0) from supplier union all select 'since_day', count(*) filter (where s_suppkey % 7 = 0) from supplier")
def s5_bad_cells(spark, d):
    """How many cells of each column do not parse."""
    return delimited.bad_cells(spark, _supplier_csv(spark, d), {"supp_key": "long", "bal": "double", "since_day": "date"})


@query("select 'S' || s_suppkey as jcat, case when s_suppkey % 3 <> 0 then s_name end as name, case when s_suppkey % 4 <> 0 then s_nationkey + 0.5 end::double as mass, case when s_suppkey % 4 = 0 then 'heavy' end as unparsed, case when s_suppkey % 2 = 0 then 'x' || s_nationkey end as other from supplier")
def s2_s4_commented_tsv(spark, d):
    """A commented TSV: mapped columns, numbers that do not parse and other columns in the overflow map."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    tab = F.lit("\t")
    path = _lines(s, F.when(k == 1, "# banner\n").otherwise(""), F.lit("S"), _s("s_suppkey"), tab, F.when(k % 3 == 0, "-").otherwise(F.col("s_name")), tab, F.when(k % 4 == 0, "heavy").otherwise((F.col("s_nationkey") + 0.5).cast("string")), tab, F.when(k % 2 == 0, F.concat(F.lit("x"), _s("s_nationkey"))).otherwise(" "), head="#JCAT\tName\tMass\tOther")
    got = delimited.read_commented_tsv(spark, path, {"JCAT": "jcat", "Name": "name", "Mass": "mass"}, {"mass": "double"})
    return got.select("jcat", "name", "mass", F.try_element_at("extra", F.lit("_unparsed_mass")).alias("unparsed"), F.try_element_at("extra", F.lit("Other")).alias("other"))


@query("select cast(o_orderdate as date) as day, (o_orderkey % 90)::integer as kp1 from orders where o_orderkey % 6 <> 0")
def s6_s8_mapped_csv(spark, d):
    """A CSV whose every header must be known; rows without their key go."""
    path = _lines(table(spark, d, "orders"), F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(","), (F.col("o_orderkey") % 90).cast("string"), head="DATE,KP1")
    return delimited.read_mapped_csv(spark, path, {"DATE": "day", "KP1": "kp1"}, {"day": "date", "kp1": "int"})


@query("select p_name as name, 'D' || p_partkey as cospar_id, case when p_size <> 7 then p_size::varchar end as size_text, sha1(p_name || '|D' || p_partkey) as row_key from part")
def s14_seed_file(spark, d):
    """A delimited seed whose separator is found out, with a key by hash."""
    size = F.when(F.col("p_size") == 7, "-").otherwise(_s("p_size"))
    path = _lines(table(spark, d, "part"), F.col("p_name"), F.lit(";D"), _s("p_partkey"), F.lit(";"), size, head="Name;COSPAR;Size")
    got = delimited.read_seed(spark, path, {"Name": "name", "COSPAR": "cospar_id"}, "name", "cospar_id")
    return got.select("name", "cospar_id", F.try_element_at("extra", F.lit("Size")).alias("size_text"), "row_key")


@query("select 'S' || s_suppkey as call_sign, case when s_suppkey % 3 <> 0 then s_name end as name from supplier where s_suppkey % 4 <> 0")
def s12_keyword_table(spark, d):
    """An exported sheet: its header is found by words, section lines go, N/A is null."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    body = s.select((k + 10).alias("i"), F.array(F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("S"), _s("s_suppkey"))), F.lit("z"), F.when(k % 3 == 0, "N/A").otherwise(F.col("s_name"))).alias("cells"))
    top = spark.createDataFrame([(0, ["Report", "", ""]), (1, ["The Call Sign", "Other", "Satellite Name"])], "i long, cells array<string>")
    return delimited.read_keyword_table(top.unionByName(body), "cells", "i", {"call_sign": ("call",), "name": ("satellite", "name")})


# ------------------------------------------------------------------ dumps, JSON, trees
@query("select o_orderkey::varchar as a, 'Café ' || o_orderpriority as b, case when o_orderkey % 3 <> 0 then 'two' || chr(13) || chr(10) || 'lines' end as c, null::varchar as d from orders")
def s9_record_dump(spark, d):
    """A dump in a single-byte encoding with its own record end, split by Spark's reader."""
    k = F.col("o_orderkey")
    cafe = F.concat(F.lit(b"Caf\xe9 "), F.col("o_orderpriority").cast("binary")).cast("string")
    path = _lines(table(spark, d, "orders"), _s("o_orderkey"), F.lit("|"), cafe, F.when(k % 3 != 0, "| two\r\nlines ").otherwise("| "), F.when(k % 2 == 0, "|").otherwise(""), end=records.RECORD_END)
    return records.read_records(spark, path, ["a", "b", "c", "d"])


@query("select user_id as norad_id, epoch, mean_motion, source from (select user_id, timestamp '2024-01-01 00:00:00' + to_seconds(user_id) as epoch, (user_id + 0.25)::double as mean_motion, 'gp' as source from (select distinct user_id from events)) where user_id % 4 <> 0")
def s7_element_sets(spark, d):
    """An array of element sets with numbers as text; those without an id or epoch go."""
    return _elements(spark, d)[0].select("norad_id", F.col("epoch").cast("timestamp_ntz").alias("epoch"), "mean_motion", "source")


@query("select count(*)::bigint as skipped from (select distinct user_id from events) where user_id % 4 = 0")
def s7_skipped(spark, d):
    return _elements(spark, d)[1]


def _elements(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("user_id")
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + k), "yyyy-MM-dd'T'HH:mm:ss")
    one = F.to_json(F.struct(F.when(k % 4 != 0, k.cast("string")).alias("NORAD_CAT_ID"), at.alias("EPOCH"), (k + 0.25).cast("string").alias("MEAN_MOTION"), F.lit("zzz").alias("BSTAR")))
    rows = table(spark, d, "events").select("user_id").distinct().agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("j"))
    return documents.read_elements(spark, _lines(rows, F.col("j")), "gp")


@query("select 'u' || s_suppkey as uuid, s_suppkey % 2 = 0 as alive, case when s_suppkey % 3 <> 0 then s_acctbal end as baud from supplier")
def s13_known_keys(spark, d):
    """API records by a declared schema: unknown keys dropped, absent ones null, in pages with results."""
    k = F.col("s_suppkey")
    one = F.to_json(F.struct(F.concat(F.lit("u"), _s("s_suppkey")).alias("uuid"), (k % 2 == 0).alias("alive"), F.when(k % 3 != 0, F.col("s_acctbal")).alias("baud"), F.lit(1).alias("zzz")))
    rows = table(spark, d, "supplier").groupBy((k % 3).alias("page")).agg(F.concat(F.lit('{"next":null,"results":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("j"))
    path = shared_folder(spark, "landing")
    rows.select(F.col("j").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return documents.read_known_keys(spark, path, "uuid string, alive boolean, baud double")


@query("""select c_custkey as k, 'f' || c_custkey as id, c_name as name, 'h/a/f' || c_custkey as url, strftime(date '2000-01-01' + (c_custkey % 300)::integer, '%Y-%m-%d') as date from customer where c_custkey % 5 <> 0
union all select c_custkey, 'g' || c_custkey, 'inner', 'h/g' || c_custkey || '/', '2011-12-13' from customer where c_custkey % 5 <> 0""")
def s19_json_tree(spark, d):
    """Named links at any depth, with the nearest date around them; a broken body gives none."""
    k = _s("c_custkey")
    day = F.date_format(F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")
    body = F.concat(F.lit('{"date":{"display_value":"'), day, F.lit(' 11:00"},"w":[[{"x":{"name":" '), F.col("c_name"), F.lit('","url":"h/a/f'), k, F.lit('?s=1"}}],{"name":"inner","date":"2011-12-13 x","url":"h/g'), k, F.lit('/"},{"name":"twice","url":"z/f'), k, F.lit('"}]'), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("}"))
    return documents.walk_json(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), body.alias("body")), "k", "body")


# ------------------------------------------------------------------ ledger and sinks
@query("""with r as (select o_orderpriority as source, case when o_orderkey % 2 = 0 then 'https://h/class/gp_' || case when o_orderkey % 3 = 0 then 'a' else 'b' end || '/x/' || o_orderkey else 'e' || o_orderkey % 5 end as ep, case when o_orderstatus = 'F' then 'ok' when o_orderstatus = 'P' then 'error' end as st, o_orderdate as s, case when o_orderstatus <> 'O' then o_orderdate + interval 1 hour end as f, o_orderkey as n from orders),
m as (select source, coalesce(nullif(regexp_extract(ep, 'class/([a-z_]+)', 1), ''), ep) as endpoint, coalesce(st, case when s >= timestamp '2001-07-31' then 'running' else 'stale' end) as status, s, f, n from r),
l as (select * from (select *, row_number() over (partition by source, endpoint, status order by s desc nulls last, f desc nulls last, n desc nulls last) as rn from m) where rn = 1)
select source, endpoint, status, f as finished_at, n as rows_ingested from l order by coalesce(f, s) desc nulls last, source, endpoint, status limit 20""")
def dm2_recent_activity(spark, d):
    """The ledger's newest runs by source, endpoint and status."""
    k = F.col("o_orderkey")
    end = F.when(k % 2 == 0, F.concat(F.lit("https://h/class/gp_"), F.when(k % 3 == 0, "a").otherwise("b"), F.lit("/x/"), k.cast("string"))).otherwise(F.concat(F.lit("e"), (k % 5).cast("string")))
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), end.alias("endpoint"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "error").alias("status"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") != "O", F.expr("o_orderdate + interval 1 hour")).alias("finished_at"), k.alias("rows_ingested"))
    return ledger.recent_activity(runs, dt.datetime(2001, 8, 1))


@query("select s_suppkey, s_name, 2::bigint as ingest_run_id from supplier where s_suppkey % 2 = 0")
def k1_newest_run(spark, d):
    """Rows appended under their run's number, and the newest finished run read back."""
    path, s = shared_folder(spark, "landing"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    for run, rows in ((1, s), (2, s.where("s_suppkey % 2 = 0")), (3, s.limit(1))):
        ledger.append_run(rows, path, run)
    runs = spark.createDataFrame([(1, "x", "ok"), (2, "x", "ok"), (3, "x", "error")], "ingest_run_id long, source string, status string")
    raw = spark.read.parquet(path).withColumn("ingest_run_id", F.col("ingest_run_id").cast("long"))
    return relational.rows_of_latest_ok_run(raw, runs, "x").select("s_suppkey", "s_name", "ingest_run_id")


@query("select s_suppkey, s_acctbal from supplier where s_acctbal > 0")
def k7_published(spark, d):
    """A table published twice: readers find the newest version."""
    path, s = shared_folder(spark, "landing"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    ledger.publish(s, path)
    ledger.publish(s.where("s_acctbal > 0"), path)
    return ledger.current(spark, path)


@query("""select w.window_start, w.window_end, count(*)::bigint as ids from (select date '2024-01-10' as window_start, date '2024-02-01' as window_end union all select date '2024-02-01', date '2024-03-01' union all select date '2024-03-01', date '2024-03-15') w, supplier group by 1, 2""")
def s23_d6_pending_units(spark, d):
    """What a backfill still has to fetch: monthly windows by batches of ids; here none is done yet."""
    windows = dates.month_windows(spark, dt.date(2024, 1, 10), dt.date(2024, 3, 15))
    done = spark.createDataFrame([], "window_start date, batch_no int")
    units = ledger.pending_units(windows, table(spark, d, "supplier").select("s_suppkey"), done, "s_suppkey", 10)
    return units.groupBy("window_start", "window_end").agg(F.sum(F.size("ids")).alias("ids"))


# ------------------------------------------------------------------ streams
@query("select event_id, user_id, ts from events")
def st3_stream_distinct(spark, d):
    """A stream in which a third of all rows comes twice, each id let through once."""
    path, e = shared_folder(spark, "landing"), table(spark, d, "events").select("event_id", "user_id", "ts")
    e.write.parquet(path)
    e.where("event_id % 3 = 0").write.mode("append").parquet(path)
    stream = rollup.timed(rollup.source(spark, path, e.schema, 4), "ts", "60 days")
    return rollup.run_into_files(rollup.deduplicated(stream, ["event_id"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as new_, event_id from events), g as (select *, sum(new_) over (partition by user_id order by ts, event_id) as g from s)
select user_id, min(ts) as first_ts, count(*)::bigint as n from g group by user_id, g""")
def st6_session_windows(spark, d):
    """Sessions by the expression that streams use, over a batch."""
    out = rollup.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("""select user_id, cast(ts as date) as "day", case when cast(ts as date) >= date '2024-01-25' then count(*) else 0 end::bigint as n from events group by 1, 2""")
def st7_served_tail(spark, d):
    """Written days, and those of the live tail computed now."""
    e = table(spark, d, "events")
    roll = lambda x: metrics.daily(x, "user_id", "ts", "value").select("user_id", "day", "n")
    stale = roll(e).withColumn("n", F.lit(0).cast("long"))
    return rollup.serve(stale, e.where("ts >= timestamp_ntz '2024-01-25'"), roll)


# ------------------------------------------------------------------ small functions
@query("""select p_partkey, printf('20%02d-%03d', p_partkey % 30, p_partkey % 999) || upper(chr(97 + (p_partkey % 3)::integer)) as cospar, printf('20%02d-%03d', p_partkey % 30, p_partkey % 999) as launch, upper('odd ' || p_partkey) as other, case p_partkey % 5 when 0 then 'PAYLOAD' when 1 then 'ROCKET_BODY' when 2 then 'DEBRIS' else 'UNKNOWN' end as kind,
 case p_partkey % 4 when 0 then 'US' when 1 then 'GB' when 2 then 'JP' end as country from part""")
def t2_t6_codes(spark, d):
    """Designators, launch keys, object types and countries in their many spellings."""
    k = F.col("p_partkey")
    loose = F.concat(F.format_string(" 20%02d %d", k % 30, k % 999), F.element_at(F.array(F.lit("a "), F.lit("b"), F.lit(" C")), (k % 3 + 1).cast("int")))
    pick = lambda n, *options: F.element_at(F.array(*(F.lit(o) for o in options)), (k % n + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", names.norm_cospar(loose).alias("cospar"), names.launch_key(loose).alias("launch"), names.norm_cospar(F.concat(F.lit("odd "), k.cast("string"))).alias("other"), names.object_type(pick(5, " pay", "R/B", "deb", "X", "?")).alias("kind"), names.country(pick(4, " United States", "uk", "JPN", "Atlantis")).alias("country"))


@query("""select p_partkey, p_partkey % 2 = 0 as uncertain, case when p_partkey % 5 <> 0 then p_name end as certain, case p_partkey % 3 when 0 then 'norad:' || p_partkey when 1 then 'jcat:J' || p_partkey else 'sat:' || p_partkey end as ref, case when p_partkey % 4 = 0 then 'English' when p_partkey % 4 = 1 then 'Short' when p_partkey % 4 = 2 then 'Plain' else 'C' end as shown,
 'SAT-LOA-20240101-' || lpad(p_partkey::varchar, 5, '0') as file from part""")
def t8_t17_marks(spark, d):
    """Uncertainty marks, references to subjects, names to show, file numbers with dashes."""
    k, s = F.col("p_partkey"), _s("p_partkey")
    bus = F.concat(F.when(k % 5 == 0, "unknown").otherwise(F.col("p_name")), F.when(k % 2 == 0, "?").otherwise(""))
    name = F.when(k % 4 == 2, "Plain").when(k % 4 == 0, "Ünïcode")
    shown = names.display_name(name, F.when(k % 4 == 0, "English"), F.when(k % 4 == 1, "Short"), F.lit("C"))
    ref = names.subject_ref(F.when(k % 3 == 0, k), F.when(k % 3 == 1, F.concat(F.lit("J"), s)), k)
    return table(spark, d, "part").select("p_partkey", names.is_uncertain(bus).alias("uncertain"), names.certain(bus).alias("certain"), ref.alias("ref"), shown.alias("shown"), names.dashed_file_number(F.concat(F.lit("SATLOA20240101"), F.lpad(s, 5, "0"))).alias("file"))


@query("""select o_orderkey, cast(cast(o_orderdate as date) - interval 7 month as date) as before, case when o_totalprice < 2000 then 'LEO' when o_totalprice * 0.9 < 2000 then 'HEO' when o_totalprice * 0.9 between 35286 and 36286 and o_totalprice between 35286 and 36286 then 'GEO' else 'MEO' end as regime, cast(o_orderdate as date) as legacy,
 case when o_totalprice < 2000 then 'LEO' when o_totalprice < 35586 then 'MEO' when o_totalprice <= 35986 then 'GEO' else 'HEO' end as by_mean from orders""")
def d4_t5_s11_values(spark, d):
    """Months before a date, regimes by both definitions, and dates in an old export's form."""
    o = table(spark, d, "orders")
    old = F.concat(F.date_format("o_orderdate", "MMM  d yyyy  "), F.lit("4:50:24:023PM"))
    return o.select("o_orderkey", dates.months_before(F.to_date("o_orderdate"), 7).alias("before"), orbit.regime(F.col("o_totalprice") * 0.9, F.col("o_totalprice")).alias("regime"), dates.legacy_datetime(old).alias("legacy"), orbit.regime_by_mean(F.col("o_totalprice")).alias("by_mean"))


# ------------------------------------------------------------------ more of the graph
@query("with o as (select n_nationkey::bigint as operator_id, n_name as canonical_name from nation), r as (select n_nationkey::bigint as child_id, (n_nationkey % 10)::bigint as parent_id from nation where n_nationkey >= 10) select canonical_name as operator, operator_id from o where operator_id < 4 union select p.canonical_name, child_id from r join o p on p.operator_id = parent_id where parent_id < 4")
def j17_children(spark, d):
    """Named organisations and those one step below them."""
    n = table(spark, d, "nation")
    ops = n.select(F.col("n_nationkey").cast("long").alias("operator_id"), F.col("n_name").alias("canonical_name"))
    rel = n.where("n_nationkey >= 10").select(F.col("n_nationkey").cast("long").alias("child_id"), (F.col("n_nationkey") % 10).cast("long").alias("parent_id"))
    return reports.with_children(ops, rel, [r["canonical_name"] for r in ops.where("operator_id < 4").collect()])


@query("""with c as (select o_custkey as id, o_orderpriority as source, o_orderstatus as v from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1)
select id as satellite_id, case v when 'O' then 'ACTIVE' when 'F' then 'DECAYED' end as status, source from (select *, row_number() over (partition by id order by source) as rn from c where v in ('O', 'F')) where rn = 1""")
def v28_resolved_status(spark, d):
    """Status by precedence, a source whose value says nothing falling through."""
    o = relational.latest_per_key(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")])
    claims = o.select(F.col("o_custkey").alias("satellite_id"), F.lit("status").alias("attribute"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("value"), F.lit(None).cast("timestamp").alias("observed_at"))
    sources = sorted(r[0] for r in o.select("o_orderpriority").distinct().collect())
    words = spark.createDataFrame([(s, v, c) for s in sources for v, c in (("O", "ACTIVE"), ("F", "DECAYED"), ("P", "UNKNOWN"))], "source string, value string, canonical_status string")
    return identity.resolve_status(claims, words, sources)[0]


@query("""with p as (select c_custkey as k, c_nationkey as r from customer), c as (select c_custkey as k, case when c_custkey % 9 = 0 then c_nationkey + 1 else c_nationkey end as r from customer where c_custkey % 7 <> 0),
i as (select c_custkey::varchar as id_value, case when c_custkey % 5 = 0 then date '2020-01-01' end as vt from customer)
select id_value, case when same then null when vt is null then date '2024-01-01' else vt end as valid_to from (select i.*, exists (select 1 from p join c using (k) where p.r = c.r and k::varchar = id_value) as same from i)""")
def v25_expired_identifiers(spark, d):
    """Identifiers whose referent changed or left are closed, those that came back are open again."""
    c = table(spark, d, "customer")
    k, r = F.col("c_custkey"), F.col("c_nationkey")
    prev, cur = c.select(k.alias("k"), r.alias("r")), c.where(k % 7 != 0).select(k.alias("k"), F.when(k % 9 == 0, r + 1).otherwise(r).alias("r"))
    ids = c.select(k.alias("satellite_id"), F.lit("norad").alias("id_type"), k.cast("string").alias("id_value"), F.when(k % 5 == 0, F.lit(dt.date(2020, 1, 1))).alias("valid_to"))
    return identity.detect_churn(prev, cur, ids, "k", "r", "norad", dt.date(2024, 1, 1))[0].select("id_value", "valid_to")


@query("select c_custkey as satellite_id, case when c_custkey % 3 <> 0 then 'anchored' else 'provisional' end as anchor_state from customer")
def u11_anchors(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("satellite_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("norad_id"), F.lit("provisional").alias("anchor_state"))
    return mutations.refresh_anchors(c).select("satellite_id", "anchor_state")


@query("""select c_custkey as satellite_id, list_sort(['norad:' || c_custkey] || case when c_custkey % 2 = 0 then ['cospar:c' || c_custkey] else [] end) as identifiers, coalesce(o.claims, []) as claims, n_name as operator from customer left join nation on n_nationkey = c_nationkey
left join (select o_custkey, list_sort(list(distinct 'status=' || o_orderstatus || ' (' || o_orderpriority || ')')) as claims from orders group by 1) o on o_custkey = c_custkey""")
def q3_evidence(spark, d):
    """Everything known of an entity in one nested row, in a fixed order."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    ids = c.select(k.alias("satellite_id"), F.lit("norad").alias("id_type"), k.cast("string").alias("id_value")).unionByName(c.where(k % 2 == 0).select(k.alias("satellite_id"), F.lit("cospar").alias("id_type"), F.concat(F.lit("c"), k.cast("string")).alias("id_value")))
    claims = table(spark, d, "orders").select(F.col("o_custkey").alias("satellite_id"), F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value"), F.col("o_orderpriority").alias("source"))
    owners = c.select(k.alias("satellite_id"), F.col("c_nationkey").cast("long").alias("operator_id"), F.lit(dt.date(2000, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    ops = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("operator_id"), F.col("n_name").alias("canonical_name"))
    got = reports.evidence(c.select(k.alias("satellite_id")), ids, claims, owners, ops)
    return got.select("satellite_id", F.transform("identifiers", lambda i: F.concat_ws(":", i["id_type"], i["id_value"])).alias("identifiers"), F.transform("claims", lambda x: F.concat(x["attribute"], F.lit("="), x["value"], F.lit(" ("), x["source"], F.lit(")"))).alias("claims"), F.get("owners", F.lit(0))["operator"].alias("operator"))


@query("""with a as (select c_mktsegment as slug, count(*)::varchar as n from customer where c_acctbal > 3000 group by 1), b as (select c_mktsegment as slug, count(*)::varchar as n from customer where c_acctbal > 2500 and c_mktsegment <> 'BUILDING' group by 1)
select slug, 'vanished' as change, null::varchar as metric, null::varchar as before, null::varchar as after from a where slug not in (select slug from b) union all select slug, 'changed', 'n', a.n, b.n from a join b using (slug) where a.n <> b.n""")
def v46_published_diff(spark, d):
    """A board captured to a file, and what a later one changes against it."""
    c = table(spark, d, "customer")
    board = lambda df: df.groupBy(F.col("c_mktsegment").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    path = shared_folder(spark, "landing")
    captured = ledger.baseline(board(c.where("c_acctbal > 3000")), "slug")
    spark.createDataFrame([(captured,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    before = spark.read.schema("slug string, n long").json(path, multiLine=True)
    return compare.diff(before, board(c.where("c_acctbal > 2500 and c_mktsegment <> 'BUILDING'")), "slug", ["n"])
