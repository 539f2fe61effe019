"""Explicit schemas: nothing in this package infers one."""

from pyspark.sql import types as T


def struct_of(spec: str) -> T.StructType:
    names = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(),
             "b": T.BooleanType(), "h": T.ShortType(), "D": T.DateType(), "t": T.TimestampType()}
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, names[kind]) for name, kind in fields])


AGENCY = struct_of("agency_id:s agency_name:s agency_url:s agency_timezone:s agency_lang:s")
ROUTES = struct_of("route_id:s agency_id:s route_short_name:s route_long_name:s route_desc:s route_type:i")
STOPS = struct_of("stop_id:s stop_code:s stop_name:s stop_lat:d stop_lon:d")
TRIPS = struct_of("trip_id:s route_id:s service_id:s trip_headsign:s direction_id:i shape_id:s")
STOP_TIMES = struct_of("trip_id:s stop_id:s stop_sequence:l arrival_time:s departure_time:s "
                     "arrival_s:i departure_s:i")
SHAPES = struct_of("shape_id:s shape_pt_sequence:i shape_pt_lat:d shape_pt_lon:d shape_dist_traveled:d")

POSITIONS = struct_of("vehicle_id:s ts:l trip_id:s route_id:s lat:d lon:d bearing:d speed:d stop_id:s "
                    "current_status:i congestion_level:i occupancy_status:i ingested_at:l")
POSITION_COLUMNS = POSITIONS.fieldNames()
POLLS = struct_of("polled_at:l ok:i source:s http_status:i entity_count:i new_rows:i "
                "feed_timestamp:l latency_ms:i error:s")
DEADLETTERS = T.StructType(POSITIONS.fields + struct_of("reason:s quarantined_at:l").fields)

GRID_HOUR = struct_of("cell_y:i cell_x:i hour_bucket:l observations:l vehicles:l moving:l stopped:l "
                    "speed_sum:d speed_n:l speed_min:d speed_max:d")
ROUTE_HOUR = struct_of("route_id:s hour_bucket:l observations:l vehicles:l moving:l stopped:l "
                     "speed_sum:d speed_n:l")
CONTINUITY_HOUR = struct_of("hour_bucket:l gaps_total:l gaps_over_threshold:l b_0_60:l b_60_180:l "
                          "b_180_300:l b_300_600:l b_600_plus:l")
VEHICLE_GAP_STATE = struct_of("vehicle_id:s last_ts:l")
TRIP_GAP_STATE = struct_of("vehicle_id:s trip_id:s last_ts:l has_gap:b")
TRIP_MATCH = struct_of("live_trip_id:s vehicle_id:s route_id:s matched_trip_id:s match_type:s "
                     "delta_minutes:d matched_at:l")
TRIP_STATUS = struct_of("service_date:D trip_id:s zone_id:h route_id:s start_time:s status:s "
                      "stops_total:i stops_skipped:i stops_with_delay:i max_delay_s:i "
                      "first_seen:t last_seen:t canceled_at:t poll_id:l")
STOP_DELAY = struct_of("service_date:D trip_id:s stop_sequence:l stop_id:s arrival_delay_s:i "
                     "departure_delay_s:i stop_status:s implausible:b changes:h first_seen:t last_seen:t")

# Feed messages as they arrive.
POSITION_MESSAGE = (
    "struct<header:struct<timestamp:bigint>,entity:array<struct<id:string,vehicle:struct<"
    "trip:struct<trip_id:string,route_id:string>,"
    "position:struct<latitude:double,longitude:double,bearing:double,speed:double>,"
    "timestamp:bigint,stop_id:string,current_status:int,congestion_level:int,occupancy_status:int,"
    "vehicle:struct<id:string,label:string>>>>>"
)
VEHICLE_MESSAGE = (
    "struct<header:struct<timestamp:string>,entity:array<struct<id:string,vehicle:struct<"
    "trip:struct<trip_id:string,start_time:string,start_date:string,schedule_relationship:string,"
    "route_id:string,sch_no:string>,"
    "position:struct<latitude:string,longitude:string,bearing:string>,"
    "current_status:string,timestamp:string,stop_id:string,vehicle:struct<id:string,label:string>>>>>"
)
TRIP_MESSAGE = (
    "struct<entity:array<struct<id:string,trip_update:struct<"
    "trip:struct<trip_id:string,start_time:string,start_date:string,schedule_relationship:string,"
    "route_id:string>,"
    "stop_time_update:array<struct<stop_sequence:string,arrival:struct<delay:string>,"
    "departure:struct<delay:string>,stop_id:string,schedule_relationship:string>>>>>>"
)
