"""Queries by name, with checked parameters: what the reference serves over HTTP, as lazy frames.

engine = Engine(tables); engine.query("leaderboard", sort="fleet", min_n=5, limit=20). Tables are frames by name; what is read
together by many queries is kept for `ttl` seconds.
"""

from __future__ import annotations

import datetime as dt
import inspect
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import orbit, propagate
from ..operators import mutations, relational
from ..sources import ledger
from . import metrics, reports

#: What a person may say of a case. Fixed values.
VERDICTS = ("correct", "incorrect", "partial", "unresolvable")


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, int(value)))


class Kept:
    """A frame cached for a time, then read anew."""

    def __init__(self, make: Callable[[], DataFrame], ttl: float = 900.0, clock=time.monotonic):
        self.make, self.ttl, self.clock, self.at, self.df = make, ttl, clock, None, None

    def get(self) -> DataFrame:
        if self.df is None or self.clock() - self.at >= self.ttl:
            if self.df is not None:
                self.df.unpersist()
            self.df, self.at = self.make().cache(), self.clock()
        return self.df


class Engine:
    def __init__(self, tables: dict[str, DataFrame], ttl: float = 900.0):
        self.tables = tables
        self.kept = {"latest": Kept(lambda: metrics.latest_elements(tables["elements"], "norad_id", "epoch", "source"), ttl)}

    def tools(self) -> dict[str, dict[str, str]]:
        """Every query with its parameters and their defaults, for callers that choose by name."""
        return {n: {p.name: "required" if p.default is p.empty else repr(p.default) for p in inspect.signature(getattr(self, f"q_{n}")).parameters.values()} for n in self.names()}

    def names(self) -> list[str]:
        return sorted(n[2:] for n in dir(self) if n.startswith("q_"))

    def query(self, name: str, **params) -> DataFrame:
        if name not in self.names():
            raise ValueError(f"{name!r} is not one of {self.names()}")
        return getattr(self, f"q_{name}")(**params)

    # -------------------------------------------------------------- entities
    def q_search(self, q: str, limit: int | None = None) -> DataFrame:
        return relational.search(self.tables["satellite"], q, "norad_id", "canonical_name", "cospar", clamp(limit, 1, 20, 20))

    def q_detail(self, satellite_id: int) -> DataFrame:
        """One row: the entity with its current status, owner and newest elements."""
        s = self.tables["satellite"].where(F.col("satellite_id") == satellite_id)
        status = relational.latest_per_key(self.tables["status"].where(F.col("satellite_id") == satellite_id), ["satellite_id"], [F.col("observed_at").desc(), F.col("source").asc()]).select("satellite_id", "canonical_status")
        owner = self.tables["satellite_operator"].where((F.col("satellite_id") == satellite_id) & F.col("valid_to").isNull()).select("satellite_id", "operator_id")
        element = self.kept["latest"].get().select("norad_id", "epoch", "perigee_km", "apogee_km")
        return s.join(status, "satellite_id", "left").join(owner, "satellite_id", "left").join(element, "norad_id", "left").withColumn("regime", orbit.regime(F.col("perigee_km"), F.col("apogee_km")))

    def q_claims(self, satellite_id: int) -> DataFrame:
        """Every claim about the entity, and whether its attribute is disputed."""
        c = self.tables["source_assertion"].where(F.col("satellite_id") == satellite_id)
        n = c.groupBy("attribute").agg(F.count_distinct("value").alias("n"))
        return c.join(n, "attribute").select("attribute", "source", "value", "observed_at", (F.col("n") > 1).alias("disputed")).orderBy("attribute", "source", "value")

    def q_track(self, norad_id: int, points: int | None = None) -> DataFrame:
        return relational.downsample(self.tables["daily"].where(F.col("norad_id") == norad_id), "day", clamp(points, 2, 400, 400), ["sma_avg", "perigee_min", "apogee_max"], ["elset_count"]).orderBy("bucket")

    # -------------------------------------------------------------- operators
    def q_operators(self, sort: str = "fleet", limit: int | None = None, offset: int = 0) -> DataFrame:
        """The league: fleet sizes by owner, with the parent's name."""
        own = self.tables["satellite_operator"].where("valid_to is null").select("satellite_id", "operator_id")
        status = relational.latest_per_key(self.tables["status"], ["satellite_id"], [F.col("observed_at").desc(), F.col("source").asc()]).select("satellite_id", "canonical_status")
        fleet = own.join(status, "satellite_id", "left").groupBy("operator_id").agg(F.count(F.lit(1)).alias("fleet_total"), F.count_if(F.coalesce(F.col("canonical_status") != "DECAYED", F.lit(True))).alias("fleet_on_orbit"), F.count_if(F.coalesce(F.col("canonical_status") == "ACTIVE", F.lit(False))).alias("fleet_active"))
        order = relational.choose(sort, {"fleet": lambda: [F.col("fleet_total").desc(), F.col("operator_id").asc()], "name": lambda: [F.col("canonical_name").asc_nulls_last(), F.col("operator_id").asc()]})
        ops = self.tables["operator"]
        parent = ops.select(F.col("operator_id").alias("parent_id"), F.col("canonical_name").alias("parent_name"))
        return relational.page(fleet.join(ops, "operator_id").join(parent, "parent_id", "left"), order, clamp(limit, 1, 200, 50), offset)

    def q_regimes(self, operator_id: int) -> DataFrame:
        """Regimes of an operator's fleet by mean altitude; objects without elements are NO_ELEMENTS, so the counts add up."""
        own = self.tables["satellite_operator"].where((F.col("operator_id") == operator_id) & F.col("valid_to").isNull()).select("satellite_id")
        s = self.tables["satellite"].join(own, "satellite_id", "left_semi").select("satellite_id", "norad_id")
        e = self.kept["latest"].get().select("norad_id", ((F.col("perigee_km") + F.col("apogee_km")) / 2).alias("alt"))
        kind = F.when(F.col("alt").isNull(), "NO_ELEMENTS").otherwise(orbit.regime_by_mean(F.col("alt")))
        return s.join(e, "norad_id", "left").groupBy(kind.alias("regime")).agg(F.count(F.lit(1)).alias("n"))

    # -------------------------------------------------------------- products
    SORTS: dict[str, Callable[[], list[Column]]] = {
        "fleet": lambda: [F.col("fleet_total").desc_nulls_last(), F.col("slug").asc()],
        "station_keeping": lambda: [F.col("p50_station_keeping_km").asc_nulls_last(), F.col("slug").asc()],
        "lifetime": lambda: [F.col("median_lifetime_years").desc_nulls_last(), F.col("slug").asc()],
        "disposal": lambda: [F.col("disposal_compliance_pct").desc_nulls_last(), F.col("slug").asc()],
    }

    def _board(self, anchored_only: bool) -> DataFrame:
        return metrics.leaderboard(self.tables["product"], "slug", anchored_only)

    def q_leaderboard(self, sort: str = "fleet", min_n: int = 1, q: str | None = None, state: str = "all", limit: int | None = None, offset: int = 0) -> DataFrame:
        from ..functions.names import like_literal

        if state not in ("all", "anchored"):
            raise ValueError("state is all or anchored")
        board = self._board(state == "anchored").where(F.col("fleet_total") >= min_n)
        if q:
            board = board.where(F.col("slug").ilike(like_literal(q)))
        return relational.page(board, relational.choose(sort, self.SORTS), clamp(limit, 1, 200, 50), offset)

    def q_receipts(self, slug: str, metric: str = "fleet_total") -> DataFrame:
        """The rows behind a headline number: as many as it says."""
        rules = {"fleet_total": lambda: F.lit(True), "fleet_active": lambda: F.col("status") == "ACTIVE", "decayed_count": lambda: F.col("status") == "DECAYED", "disposal_n": lambda: F.col("compliant").isNotNull(), "sk_n": lambda: F.col("sk_km").isNotNull()}
        if metric not in rules:
            raise ValueError(f"{metric!r} is not one of {sorted(rules)}")
        return self.tables["product"].where((F.col("slug") == slug) & rules[metric]())

    def resolve_slug(self, kind: str, slug: str) -> str | None:
        """The live slug of a slug that may have been renamed."""
        if self.tables["product"].where(F.col("slug") == slug).limit(1).count():
            return slug
        hit = self.tables["slug_alias"].where((F.col("kind") == kind) & (F.col("old_slug") == slug)).select("new_slug").limit(1).collect()
        return hit[0][0] if hit else None

    def q_product(self, slug: str, kind: str = "bus", state: str = "all") -> DataFrame:
        """The leaderboard row of a slug; one that was renamed is followed."""
        live = self.resolve_slug(kind, slug)
        return self._board(state == "anchored").where(F.col("slug") == F.lit(live))

    def q_history(self, slug: str, kind: str = "bus") -> DataFrame:
        """What was frozen of a slug, month by month."""
        live = self.resolve_slug(kind, slug)
        return self.tables["bus_snapshot"].where((F.col("kind") == kind) & F.col("slug").isin(*{slug, live or slug})).select("month", "slug", "payload").orderBy("month", "slug")

    # -------------------------------------------------------------- totals, audit, environment
    def q_overview(self, as_of: dt.date) -> DataFrame:
        return reports.overview(self.tables, as_of)

    def q_activity(self, now: dt.datetime) -> DataFrame:
        return ledger.recent_activity(self.tables["ingest_run"], now)

    def q_milestone(self, operator: str, low: float, high: float, as_of: dt.date) -> DataFrame:
        return reports.shell_milestone(self.tables | {"latest": self.kept["latest"].get()}, operator, low, high, as_of)

    def q_lingering(self, names: list[str]) -> DataFrame:
        return reports.lingering_board(self.tables | {"latest": self.kept["latest"].get()}, names)

    def q_decaying(self) -> DataFrame:
        return reports.active_but_decaying(self.tables["daily"], self.tables["satellite"], self.tables["status"], "sma_avg").agg(F.count(F.lit(1)).alias("n"))

    def q_environment(self, as_of: dt.date, past: int = 90, ahead: int = 0) -> DataFrame:
        return metrics.drag_selection(self.tables["environment"], F.lit(as_of), past, ahead)["days"]

    def q_visible(self, now: dt.datetime, lat: float, lon: float, min_elevation: float = 10.0) -> DataFrame:
        """What stands above the horizon of a place now, the highest first."""
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise ValueError("no such place")
        return propagate.visible_now(self.kept["latest"].get(), now, lat, lon, min_elevation=min_elevation).orderBy(F.desc("elevation"), "norad_id")

    # -------------------------------------------------------------- filings, review
    def q_filing(self, file_number: str) -> DataFrame:
        """The planes of a filing's specification, those that were checked first."""
        return self.tables["plane"].where(F.col("file_number") == file_number).orderBy(F.desc("is_validated"), "plane_idx")

    def q_docket(self, callsign: str) -> DataFrame:
        """All filings under a call sign, the oldest first."""
        return self.tables["filing"].where(F.upper("callsign") == callsign.upper()).orderBy(F.col("date_filed").asc_nulls_last(), "filing_key")

    def q_pending(self, q: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        from ..functions.names import like_literal

        f = self.tables["filing"].where(metrics.pending([c for c in self.tables["filing"].columns if c.startswith("date_") and c not in ("date_filed", "date_last_update")]))
        if q:
            f = f.where(F.col("satellite_name").ilike(like_literal(q)) | F.col("applicant_name").ilike(like_literal(q)))
        p = relational.page(f, [F.col("date_filed").desc_nulls_last(), F.col("filing_key").asc()], clamp(limit, 1, 200, 50), offset)
        return p.join(self.tables["docket"], "callsign", "left") if "docket" in self.tables else p

    def q_review(self, after: tuple | None = None, limit: int | None = None) -> DataFrame:
        """Open cases in order of type and reference, after a given one."""
        cases = self.tables["gold_case"].where("verdict is null").select("case_type", "subject_ref", "evidence")
        n = clamp(limit, 1, 100, 1)
        return relational.after(cases, ["case_type", "subject_ref"], after, n) if after else cases.orderBy("case_type", "subject_ref").limit(n)

    def record_verdict(self, case_type: str, subject_ref: str, verdict: str, at: dt.datetime) -> DataFrame:
        """The cases with a person's verdict on one of them; the caller writes them. Of a case only verdict and time change."""
        if verdict not in VERDICTS:
            raise ValueError(f"{verdict!r} is not one of {VERDICTS}")
        cases = self.tables["gold_case"]
        mine = (F.col("case_type") == case_type) & (F.col("subject_ref") == subject_ref)
        if not cases.where(mine).limit(1).count():
            raise ValueError(f"no case {case_type} {subject_ref}")
        kinds = dict(cases.dtypes)
        new = cases.where(mine).withColumn("verdict", F.lit(verdict))
        if "labelled_at" in kinds:
            new = new.withColumn("labelled_at", F.lit(at).cast(kinds["labelled_at"]))
        keep = {c: "new" if c in ("verdict", "labelled_at") else "old" for c in cases.columns}
        self.tables["gold_case"] = mutations.upsert(cases, new, ["case_type", "subject_ref"], keep)
        return self.tables["gold_case"]

    def q_verdicts(self) -> DataFrame:
        """Accuracy by case type, partly right answers counting half, and over all."""
        c = self.tables["gold_case"].where("verdict is not null")
        gradable = F.count_if(F.col("verdict").isin("correct", "partial", "incorrect"))
        cols = [F.count(F.lit(1)).alias("labelled"), gradable.alias("gradable"), ((F.count_if(F.col("verdict") == "correct") + 0.5 * F.count_if(F.col("verdict") == "partial")) / F.nullif(gradable, F.lit(0))).alias("accuracy")]
        return c.groupBy("case_type").agg(*cols).unionByName(c.agg(F.lit("all").alias("case_type"), *cols))

    def q_congestion(self, max_km: float = 2000.0) -> DataFrame:
        e = self.kept["latest"].get().withColumn("alt", (F.col("perigee_km") + F.col("apogee_km")) / 2).where(F.col("alt") < max_km)
        return metrics.density(e, orbit.bin_edge(F.col("alt"), 50), orbit.bin_edge(F.col("inclination"), 5))
