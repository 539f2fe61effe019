"""Feed messages (JSON text) to rows. Works the same on a batch and on a stream of messages."""

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..constants import DELAY_FEED_CLOCK_OFFSET_S, DELAY_FEED_RETENTION_S, IMPLAUSIBLE_DELAY_S
from ..functions import parse
from ..functions.measures import count_if
from ..operators.keyed import first_per_key

ENVELOPE = ("Data string, IsSuccess boolean, Message string, Exception string, "
            "status string, errorMessage string")


def _text(path: str):
    return F.nullif(F.col(path), F.lit(""))


def _entities(array: str):
    """Entities with their position. The outer form: an inner one makes the optimizer test the size
    of the array first, and for that parse every message twice."""
    return F.posexplode_outer(array).alias("entity_no", "e")


def position_entities(messages: DataFrame, body: str = "body") -> DataFrame:
    """(entity_no, e) of every entity that carries a vehicle, and always of the first one, which also stands for a message
    without entities; ``header_time`` is the header's own timestamp. Other columns of the message frame are kept."""
    kept = [c for c in messages.columns if c != body]
    parsed = messages.withColumn("m", F.from_json(body, schemas.POSITION_MESSAGE))
    return parsed.select(*kept, F.nullif("m.header.timestamp", F.lit(0)).alias("header_time"), _entities("m.entity")).filter(
        F.col("e.vehicle").isNotNull() | (F.coalesce("entity_no", F.lit(0)) == 0))


def position_feed_flatten(messages: DataFrame, now: int | Column, body: str = "body") -> DataFrame:
    """One row per entity that carries a vehicle.

    The id is the first non-empty of vehicle id, label and entity id; a missing timestamp falls
    back to the header's, then to ``now`` (a number, or a column of the messages). Other columns of
    the message frame are kept.
    """
    return position_rows(position_entities(messages, body).filter(F.col("e.vehicle").isNotNull()), now).filter(
        F.col("vehicle_id") != "").drop("header_time")


def position_rows(entities: DataFrame, now: int | Column) -> DataFrame:
    """The values of ``position_entities``, one row each; ``vehicle_id`` is NULL or empty where no vehicle can be named."""
    now = now if isinstance(now, Column) else F.lit(now)
    kept = [c for c in entities.columns if c not in ("entity_no", "e")]
    named = F.trim(F.coalesce(_text("e.vehicle.vehicle.id"), _text("e.vehicle.vehicle.label"), _text("e.id")))
    ts = F.coalesce(F.nullif("e.vehicle.timestamp", F.lit(0)), F.col("header_time"), now)
    position = lambda name: F.col(f"e.vehicle.position.{name}")
    return entities.select(
        *kept, "entity_no", F.when(F.col("e.vehicle").isNotNull(), named).alias("vehicle_id"), ts.alias("ts"),
        _text("e.vehicle.trip.trip_id").alias("trip_id"), _text("e.vehicle.trip.route_id").alias("route_id"),
        position("latitude").alias("lat"), position("longitude").alias("lon"),
        position("bearing").alias("bearing"), position("speed").alias("speed"),
        _text("e.vehicle.stop_id").alias("stop_id"), F.col("e.vehicle.current_status").alias("current_status"),
        F.col("e.vehicle.congestion_level").alias("congestion_level"),
        F.col("e.vehicle.occupancy_status").alias("occupancy_status"),
    )


def _leaves(kind: T.DataType, path: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for field in kind:
            yield from _leaves(field.dataType, f"{path}.{field.name}" if path else field.name)
    elif isinstance(kind, T.ArrayType):
        yield from _leaves(kind.elementType, path)
    elif path and not isinstance(kind, T.NullType):
        yield path


def message_fields(messages: DataFrame, body: str = "body") -> list[str]:
    """Dotted names of all fields that carry a value in some message, listed nowhere beforehand, in order.

    The messages are parsed to VARIANT and their types are merged inside the tasks; what comes back is one type. Fields
    that are always null, and texts that are no JSON, add nothing. Elements of an array share their names.
    """
    merged = messages.agg(F.schema_of_variant_agg(F.try_parse_json(body))).first()[0]
    if merged is None:
        return []
    # The text of a VARIANT's type is DDL but for the word OBJECT; quoted names are left as they are.
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: m[0] if m[0][0] == "`" else "STRUCT<", merged)
    return sorted(set(_leaves(T.DataType.fromDDL(ddl))))


def json_envelope_split(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds ok, data (JSON text) and error for the two response shapes of the delay feed."""
    # Parsed in a step of its own: taken from the text by each use, every field would be a parse of the message.
    read = messages.withColumn("_env", F.from_json(body, ENVELOPE)).withColumn("_keys", F.json_object_keys(F.col(body)))
    keys, env = F.col("_keys"), F.col("_env")
    filled = lambda name: F.nullif(env[name], F.lit(""))
    has = lambda name: F.array_contains(keys, name)
    ok = F.coalesce(has("IsSuccess") & env["IsSuccess"], F.lit(False))
    error = (F.when(keys.isNull(), "response is not a JSON object")
             .when(has("IsSuccess"), F.coalesce(filled("Exception"), filled("Message"), F.lit("IsSuccess=false")))
             .when((env["status"] == "Error") | has("errorMessage"), F.coalesce(filled("errorMessage"), F.lit("error")))
             .otherwise("unrecognised response shape"))
    return read.withColumn("ok", ok).withColumn("data", F.when(F.col("ok"), env["Data"])).withColumn(
        "error", F.when(~F.col("ok"), error)).drop("_env", "_keys")


def _vehicle_entities(messages: DataFrame, offset_s: int, data: str) -> DataFrame:
    parsed = messages.select("message_id", F.from_json(data, schemas.VEHICLE_MESSAGE).alias("m"))
    e = parsed.select("message_id", _entities("m.entity")).filter(F.col("e").isNotNull())
    trip = lambda name: parse.clean_text(f"e.vehicle.trip.{name}")
    cleaned = e.select(
        "message_id", "entity_no", parse.clean_text("e.vehicle.vehicle.id").alias("vehicle_id"),
        parse.clean_text("e.vehicle.vehicle.label").alias("label"),
        parse.clean_int("e.vehicle.timestamp").alias("stamp"),
        parse.clean_float("e.vehicle.position.latitude").alias("lat"),
        parse.clean_float("e.vehicle.position.longitude").alias("lon"),
        parse.clean_float("e.vehicle.position.bearing").alias("bearing"),
        trip("trip_id").alias("trip_id"), trip("route_id").alias("route_id"),
        trip("start_time").alias("start_time"), parse.compact_date("e.vehicle.trip.start_date").alias("start_date"),
        (trip("schedule_relationship") == "SCHEDULED").alias("scheduled"), trip("sch_no").alias("sch_no"),
        parse.clean_text("e.vehicle.stop_id").alias("stop_id"),
        parse.clean_int("e.vehicle.current_status").cast("int").alias("status"))
    return cleaned.withColumn("ts", F.when(F.col("stamp") > 0, F.col("stamp") - offset_s)).withColumn(
        "bearing", F.when(F.col("bearing") != 0, F.col("bearing"))).drop("stamp")


def vehicle_entities(messages: DataFrame, now: int, offset_s: int = DELAY_FEED_CLOCK_OFFSET_S,
                     retention_s: int = DELAY_FEED_RETENTION_S, data: str = "data") -> DataFrame:
    """The cleaned entities of vehicle messages (message_id, data), with ``usable`` and ``stale``."""
    entities = _vehicle_entities(messages, offset_s, data)
    complete = (F.col("vehicle_id").isNotNull() & F.col("ts").isNotNull()
                & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    fresh = F.col("ts") >= now - retention_s
    return entities.withColumn("usable", F.coalesce(complete & fresh, F.lit(False))).withColumn(
        "stale", F.coalesce(complete & ~fresh, F.lit(False)))


def vehicle_rows(entities: DataFrame) -> DataFrame:
    """Per message the newest usable entity of a vehicle, the first of equals."""
    # Usable rows rank first and the rest is cut afterwards. A filter in front would be pushed down
    # to the raw message and evaluate all of the cleaning twice.
    return first_per_key(entities.drop("stale"), ["message_id", "vehicle_id"], F.desc("usable"), F.desc("ts"), "entity_no").filter(
        "usable").drop("entity_no", "usable")


def vehicle_json_flatten(messages: DataFrame, now: int, offset_s: int = DELAY_FEED_CLOCK_OFFSET_S,
                         retention_s: int = DELAY_FEED_RETENTION_S, data: str = "data"):
    """(rows, audit) of vehicle messages (message_id, data).

    Rows need id, time and both coordinates; rows older than the retention are only counted; per
    message the newest row of a vehicle stays, the first of equals. Audit: entities and stale rows.
    """
    entities = vehicle_entities(messages, now, offset_s, retention_s, data)
    audit = entities.groupBy("message_id").agg(F.count("*").alias("entities"), count_if(F.col("stale")).alias("stale"))
    return vehicle_rows(entities), audit


def _last_of_equals(items: Column, *keys: str) -> Column:
    """The elements of an array of structs in order, of those equal in the leading fields ``keys`` only the last.

    One sort of the array; the sorted array is bound to a variable, so it isn't made again for every element.
    """
    def kept(ordered: Column) -> Column:
        def ends(x: Column, i: Column) -> Column:
            after = F.get(ordered, i + 1)
            return reduce(lambda a, b: a | b, [after[k].isNull() | (after[k] != x[k]) for k in keys])
        return F.filter(ordered, ends)

    return F.transform(F.array(F.sort_array(items)), kept)[0]


def trip_update_settled(messages: DataFrame, data: str = "data") -> DataFrame:
    """Delay messages with their ``trips`` and ``stops`` as arrays instead of the text; of duplicates in a message the last wins.

    A message is one row, so its duplicates are settled inside it: nothing is shuffled. Other columns are kept.
    """
    kept = [c for c in messages.columns if c != data]
    delay = lambda u, side: parse.clean_int(u[side]["delay"]).cast("int")

    def cleaned(u, i):
        return F.struct(
            i.alias("update_no"), parse.clean_int(u["stop_sequence"]).alias("stop_sequence"),
            parse.clean_text(u["stop_id"]).alias("stop_id"), delay(u, "arrival").alias("arrival_delay_s"),
            delay(u, "departure").alias("departure_delay_s"),
            parse.clean_text(u["schedule_relationship"]).alias("stop_status"))

    def marked(u):
        late = lambda name: F.coalesce(F.abs(u[name]) > IMPLAUSIBLE_DELAY_S, F.lit(False))
        return u.withField("implausible", late("arrival_delay_s") | late("departure_delay_s"))

    def entity(e, i):
        trip = lambda name: parse.clean_text(e["trip_update"]["trip"][name]).alias(name)
        updates = F.transform(F.filter(F.transform(e["trip_update"]["stop_time_update"], cleaned),
                                       lambda s: s["stop_sequence"].isNotNull()), marked)
        return F.struct(
            parse.service_date(e["trip_update"]["trip"]["start_date"]).alias("service_date"), trip("trip_id"), i.alias("entity_no"),
            trip("route_id"), trip("start_time"), trip("schedule_relationship"), F.coalesce(updates, F.array()).alias("updates"))

    def summary(t):
        updates = t["updates"]
        how_many = lambda test: F.size(F.filter(updates, test))
        plausible = F.filter(updates, lambda s: s["arrival_delay_s"].isNotNull() & ~s["implausible"])
        return F.struct(
            *[t[c].alias(c) for c in ("service_date", "trip_id", "route_id", "start_time")], t["schedule_relationship"].alias("status"),
            F.size(updates).alias("stops_total"), how_many(lambda s: s["stop_status"] == "SKIPPED").alias("stops_skipped"),
            how_many(lambda s: s["arrival_delay_s"].isNotNull()).alias("stops_with_delay"),
            F.array_max(F.transform(plausible, lambda s: s["arrival_delay_s"])).alias("max_delay_s"))

    parsed = messages.select(*kept, F.from_json(data, schemas.TRIP_MESSAGE).alias("m"))
    named = parsed.select(*kept, F.filter(
        F.transform("m.entity", entity), lambda e: e["trip_id"].isNotNull() & e["service_date"].isNotNull()).alias("entities"))
    at_stop = F.flatten(F.transform("entities", lambda e: F.transform(e["updates"], lambda u: F.struct(
        e["service_date"].alias("service_date"), e["trip_id"].alias("trip_id"), u["stop_sequence"].alias("stop_sequence"),
        e["entity_no"].alias("entity_no"), u.alias("u")))))
    trips = F.transform(_last_of_equals(F.col("entities"), "service_date", "trip_id"), summary)
    stops = _last_of_equals(at_stop, *_STOP_KEY)
    return named.select(*kept, F.coalesce(trips, F.array()).alias("trips"), F.coalesce(stops, F.array()).alias("stops"))


_STOP_KEY = ("service_date", "trip_id", "stop_sequence")
_STOP_VALUES = ("stop_id", "arrival_delay_s", "departure_delay_s", "stop_status", "implausible")


def settled_rows(settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trips, stops) of settled messages, one row each. The outer form, for the reason given at ``_entities``."""
    trips = settled.select("message_id", "zone_id", F.explode_outer("trips").alias("t")).filter(F.col("t").isNotNull())
    stops = settled.select("message_id", F.explode_outer("stops").alias("s")).filter(F.col("s").isNotNull())
    return trips.select("message_id", "zone_id", "t.*"), stops.select(
        "message_id", *[f"s.{c}" for c in _STOP_KEY], *[f"s.u.{c}" for c in _STOP_VALUES])


def trip_update_flatten(messages: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(trips, stops) of delay messages (message_id, zone_id, data); of duplicates in a message the last wins."""
    return settled_rows(trip_update_settled(messages.select("message_id", "zone_id", data), data))
