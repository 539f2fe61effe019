"""Transit views over the driver's star-schema tables.

Every view has a DataFrame form here and the same thing in SQL in ``driver_sql``, so that each
operator can be compared with an independent engine.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..session import configure

BASE_TS = 1_704_067_200          # 2024-01-01 00:00 UTC, start of the events
NOW = 1_706_659_200              # 2024-01-31 00:00 UTC, clock of the native-speed views
FAST_FACTOR = 240                # 30 days of events squeezed into 3 hours
NOW_FAST = BASE_TS + 10_800


def _pad2(column):
    return F.lpad(column.cast("string"), 2, "0")


def _div(column, n: int):
    return F.call_function("div", column, F.lit(n))


@dataclass
class DriverTables:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        configure(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- schedule ---------------------------------------------------------
    @cached_property
    def agency(self) -> DataFrame:
        return self.table("region").select(
            F.concat(F.lit("A"), "r_regionkey").alias("agency_id"), F.col("r_name").alias("agency_name"),
            F.lit("http://example.org").alias("agency_url"), F.lit("Asia/Kolkata").alias("agency_timezone"),
            F.lit("en").alias("agency_lang"))

    @cached_property
    def routes(self) -> DataFrame:
        return self.table("nation").select(
            F.concat(F.lit("R"), "n_nationkey").alias("route_id"),
            F.concat(F.lit("A"), "n_regionkey").alias("agency_id"),
            F.col("n_name").alias("route_short_name"),
            F.concat(F.lit("Line "), "n_nationkey").alias("route_long_name"),
            F.concat(F.lit("Via "), "n_name").alias("route_desc"), F.lit(3).alias("route_type"))

    @cached_property
    def stops(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.lit("S"), key).alias("stop_id"), F.concat(F.lit("C"), key).alias("stop_code"),
            F.col("c_name").alias("stop_name"),
            (F.lit(28.5) + F.lit(0.0005) * ((key * 37) % 400)).alias("stop_lat"),
            (F.lit(77.1) + F.lit(0.0005) * ((key * 91) % 400)).alias("stop_lon"))

    @staticmethod
    def trip_id_of(key):
        return F.concat(F.lit("R"), (key % 25), F.lit("_"), _pad2(_div(key, 25) % 30), F.lit("_"),
                        _pad2(_div(key, 750) % 60), F.lit("_"), key)

    @cached_property
    def trips(self) -> DataFrame:
        key = F.col("o_orderkey")
        route = key % 25
        shape = F.when(route == 24, None).when(
            _div(key, 25) % 5 == 0, F.concat(F.lit("SH"), route, F.lit("s"))
        ).otherwise(F.concat(F.lit("SH"), route))
        return self.table("orders").select(
            self.trip_id_of(key).alias("trip_id"), F.concat(F.lit("R"), route).alias("route_id"),
            F.lit("WD").alias("service_id"), F.col("o_orderpriority").alias("trip_headsign"),
            (key % 2).cast("int").alias("direction_id"), shape.alias("shape_id"))

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with unique (order, line number)."""
        return self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_suppkey").alias("l_suppkey"), F.min("l_shipdate").alias("l_shipdate"))

    @cached_property
    def stop_times(self) -> DataFrame:
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        departure = ((_div(key, 25) % 30) * 3600 + (_div(key, 750) % 60) * 60 + line * 300).cast("int")
        timed = self.lines.select(
            self.trip_id_of(key).alias("trip_id"), F.concat(F.lit("S"), "l_suppkey").alias("stop_id"),
            line.cast("bigint").alias("stop_sequence"), (departure - 30).alias("arrival_s"),
            departure.alias("departure_s"))
        return timed.select("trip_id", "stop_id", "stop_sequence",
                            clock.schedule_text("arrival_s").alias("arrival_time"),
                            clock.schedule_text("departure_s").alias("departure_time"),
                            "arrival_s", "departure_s")

    @cached_property
    def shapes(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        points = self.table("customer").filter(nation != 24).select(
            nation, key.cast("int").alias("shape_pt_sequence"),
            (F.lit(28.5) + F.lit(0.0005) * ((key * 37) % 400)).alias("shape_pt_lat"),
            (F.lit(77.1) + F.lit(0.0005) * ((key * 91) % 400)).alias("shape_pt_lon"))
        tags = F.when(F.col("shape_pt_sequence") % 2 == 0, F.array(F.lit(""), F.lit("s"))).otherwise(
            F.array(F.lit("")))
        return points.withColumn("tag", F.explode(tags)).select(
            F.concat(F.lit("SH"), nation, "tag").alias("shape_id"), "shape_pt_sequence",
            "shape_pt_lat", "shape_pt_lon")

    # ---- observation log --------------------------------------------------
    @cached_property
    def raw_events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "user_id", "event_type", "value",
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
            F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int").alias("k"))

    def _positions(self, ts, trip) -> DataFrame:
        eid, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
        every = lambda n: eid % n == 0
        lat = F.lit(28.5) + F.lit(0.002) * k + F.lit(0.00002) * ((eid * 7) % 100)
        lon = F.lit(77.1) + F.lit(0.002) * ((k * 37) % 100) + F.lit(0.00002) * ((eid * 13) % 100)
        speed = F.greatest(F.col("value") / F.lit(11.9371) - F.lit(1.0), F.lit(0.0))
        route = F.when(every(97), "RX").when(every(53), None).otherwise(F.concat(F.lit("R"), user % 20))
        return self.raw_events.select(
            F.concat(F.lit("V"), user).alias("vehicle_id"), ts.alias("ts"),
            F.when(F.col("event_type") != "error", trip).alias("trip_id"), route.alias("route_id"),
            F.when(~every(13), F.when(every(101), 0.0).otherwise(lat)).alias("lat"),
            F.when(~every(13) & ~every(17), F.when(every(101), 0.0).otherwise(lon)).alias("lon"),
            F.when(~every(19), (eid % 360).cast("double")).alias("bearing"),
            F.when(~every(11), speed).alias("speed"),
            F.lit(None).cast("string").alias("stop_id"),
            F.when(every(5), (eid % 3).cast("int")).alias("current_status"),
            F.lit(None).cast("int").alias("congestion_level"),
            F.lit(None).cast("int").alias("occupancy_status"),
            (ts + 5 + eid % 20).alias("ingested_at"), eid.alias("arrival"))

    @cached_property
    def positions(self) -> DataFrame:
        """One row per event, 30 days; ``arrival`` is the order of arrival."""
        eid, epoch = F.col("event_id"), F.col("epoch")
        live = F.concat(F.lit("R"), F.col("user_id") % 20, F.lit("_"), _pad2(clock.hour_of_day(epoch)),
                        F.lit("_"), _pad2(_div(epoch % 3600, 60)), F.lit("_"), eid)
        trip = (F.when(eid % 31 == 0, F.concat(F.lit("garbage-"), eid))
                .when(eid % 41 == 0, self.trip_id_of(eid)).otherwise(live))
        return self._positions(epoch, trip)

    @cached_property
    def positions_fast(self) -> DataFrame:
        """The same log squeezed into three hours, with 20-minute trips of several reports."""
        offset = _div(F.col("epoch") - BASE_TS, FAST_FACTOR)
        block = _div(offset, 1200)
        trip = F.concat(F.lit("R"), F.col("user_id") % 20, F.lit("_"), _pad2(_div(block, 3) + 5), F.lit("_"),
                        _pad2((block % 3) * 20), F.lit("_"), F.col("user_id"))
        return self._positions(F.lit(BASE_TS) + offset, trip)

    @cached_property
    def log_fast(self) -> DataFrame:
        """``positions_fast`` with unique (vehicle, ts), first arrival kept."""
        from ..operators.merge import unique_observations
        return unique_observations(self.positions_fast)

    @cached_property
    def latest_fast(self) -> DataFrame:
        from ..operators.merge import latest_projection
        return latest_projection(self.positions_fast)

    @cached_property
    def polls(self) -> DataFrame:
        """One poll per 30 s of ``positions_fast``."""
        slot = _div(F.col("ts") - BASE_TS, 30)
        per_slot = self.positions_fast.groupBy(slot.alias("slot")).agg(
            F.count("*").alias("n"), F.count_distinct("vehicle_id").alias("vehicles"),
            F.max("ts").alias("newest"), F.min("arrival").alias("first"))
        first, ok = F.col("first"), F.col("first") % 7 != 0
        kind = first % 5
        return per_slot.select(
            (F.lit(BASE_TS) + (F.col("slot") + 1) * 30).alias("polled_at"),
            ok.cast("int").alias("ok"), F.lit("feed").alias("source"),
            F.when(ok, 200).when(kind == 0, 503).when(kind == 1, 404).when(kind == 2, 200).alias("http_status"),
            F.when(ok | (kind == 4), F.col("n")).otherwise(0).cast("int").alias("entity_count"),
            F.when(ok & (first % 6 != 0), F.col("vehicles")).otherwise(0).cast("int").alias("new_rows"),
            F.when(ok & (first % 10 != 0), F.col("newest")).alias("feed_timestamp"),
            F.when(first % 8 != 0, 200 + first % 400).alias("latency_ms"),
            F.when(~ok, F.when(kind == 3, "Request TIMED OUT").otherwise("failed")).alias("error"))

    # ---- delay feed -------------------------------------------------------
    @cached_property
    def delays(self) -> DataFrame:
        """Stop delays of every order line, before they are split into rounds."""
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        orders = self.table("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
        days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
        code = key + line
        arrival = F.when(code % 10 != 0, days * 60)
        return self.lines.join(orders, key == F.col("o_orderkey")).select(
            F.col("o_orderdate").cast("date").alias("service_date"), self.trip_id_of(key).alias("trip_id"),
            line.cast("bigint").alias("stop_sequence"), F.concat(F.lit("S"), "l_suppkey").alias("stop_id"),
            arrival.cast("int").alias("arrival_delay_s"), (arrival + 15).cast("int").alias("departure_delay_s"),
            F.when(code % 23 == 0, "SKIPPED").otherwise("SCHEDULED").alias("stop_status"),
            code.alias("code"), key.alias("order_key"), F.col("o_orderstatus").alias("order_status"))

    @cached_property
    def delay_rounds(self) -> tuple:
        """(stored, incoming): some incoming rows are new, some changed, some the same."""
        implausible = F.abs("arrival_delay_s") > 7200
        columns = ["service_date", "trip_id", "stop_sequence", "stop_id", "arrival_delay_s",
                   "departure_delay_s", "stop_status"]
        stored = self.delays.filter(F.col("code") % 5 != 0).select(
            *columns, F.coalesce(implausible, F.lit(False)).alias("implausible"))
        shift = F.when(F.col("order_key") % 3 == 0, 60).otherwise(0)
        incoming = self.delays.filter(F.col("code") % 5 <= 2).withColumn(
            "arrival_delay_s", F.col("arrival_delay_s") + shift).select(
            *columns, F.coalesce(implausible, F.lit(False)).alias("implausible"))
        return stored, incoming
