"""Static files that arrive as arrays of CSV lines inside a message."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..operators.keyed import first_per_key

_TEXT, _INT, _FLOAT, _FLAG, _DATE = (parse.clean_text, parse.clean_int, parse.clean_float, parse.clean_flag,
                                     parse.compact_date)

# Per table its key and the cleaning of each column.
TABLES = {
    "agency": (["agency_id"], dict.fromkeys(
        ["agency_id", "agency_name", "agency_url", "agency_timezone", "agency_phone", "agency_lang"], _TEXT)),
    "stops": (["stop_id"], {"stop_id": _TEXT, "stop_name": _TEXT, "stop_lat": _FLOAT, "stop_lon": _FLOAT}),
    "routes": (["route_id"], {"route_id": _TEXT, "agency_id": _TEXT, "route_short_name": _TEXT,
                              "route_long_name": _TEXT, "route_desc": _TEXT, "route_type": _INT}),
    "trips": (["trip_id"], {"trip_id": _TEXT, "route_id": _TEXT, "service_id": _TEXT}),
    "stop_times": (["trip_id", "stop_sequence"], {
        "trip_id": _TEXT, "stop_sequence": _INT, "arrival_time": _TEXT, "departure_time": _TEXT, "stop_id": _TEXT}),
    "calendar": (["service_id"], {
        "service_id": _TEXT, **dict.fromkeys(
            ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"], _FLAG),
        "start_date": _DATE, "end_date": _DATE}),
}

_CUT = "\u0001"  # between fields while a line is taken apart
# A comma and a field after it; for lines with a quote inside a plain field.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


def csv_fields(line):
    """Fields of one CSV line as an array, quotes removed.

    Cut at the quotes, every other piece is quoted text. Commas count in the pieces between, and an
    empty piece between two quoted ones is a doubled quote. No pattern walks over a field, so its
    length doesn't matter.
    """
    # Bound once: the lambdas below ask for the number of pieces at every piece.
    return F.get(F.transform(F.array(F.split(line, '"')), lambda pieces: _fields(line, pieces)), F.lit(0))


def _fields(line, pieces):
    last = F.size(pieces) - 1
    def piece(text, i):
        outside = F.when((text == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(text, F.lit(","), F.lit(_CUT)))
        return F.when(i % 2 == 1, text).otherwise(outside)
    quoted = F.split(F.array_join(F.transform(pieces, piece), ""), _CUT)
    # A quote opens a field only at its start; elsewhere it is a plain character.
    stray = F.exists(F.transform(pieces, lambda text, i: (i % 2 == 0) & (i < last) & (text != "")
                                 & ~text.endswith(",")), lambda found: found)
    unquote = lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), F.replace(
        F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    plain = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1)), unquote)
    return F.when(stray, plain).otherwise(quoted)


def regex_split_records(text):
    """One long line of agency records -> one string per record.

    A record is a number, a name, a web address and more. The line is cut at the addresses; what stands before one ends
    with the name and number of its record, which are taken back from the end of the piece. A number behind a comma is a
    field of the record before, and begins none.
    """
    pieces = F.split(text, ",(?=https?://)")

    def marked(piece, i):
        name = F.substring_index(piece, ",", -1)
        head = F.substring(piece, F.lit(1), F.length(piece) - F.length(name) - 1)  # empty without a comma
        before = F.rtrim(head, F.lit("0123456789"))
        number = F.substring(head, F.length(before) + 1, F.length(head))
        begins = (number != "") & ~before.endswith(",") & (i < F.size(pieces) - 1)
        return F.when(begins, F.concat(before, F.lit(_CUT), number, F.lit(","), name)).otherwise(piece)

    return F.filter(F.split(F.array_join(F.transform(pieces, marked), ","), _CUT), lambda p: p != "")


def _lines(pulls: DataFrame, table: str) -> DataFrame:
    body = F.filter(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.trim(x) != "")
    split = pulls.filter(F.size("lines") > 0).select(
        "pull_id", csv_fields(F.get("lines", F.lit(0))).alias("header"), body.alias("body"))
    if table == "agency":
        records = regex_split_records(F.array_join("body", ""))
        split = split.withColumn("_records", records).withColumn(
            "resplit", F.size("_records") > F.size("body")).withColumn(
            "body", F.when(F.col("resplit"), F.col("_records")).otherwise(F.col("body"))).drop("_records")
    else:
        split = split.withColumn("resplit", F.lit(False))
    return split


def csv_lines_scan(pulls: DataFrame, table: str):
    """(rows, audit) of pulls (pull_id, lines).

    Lines of the wrong width, with a NULL key or a repeated key (the first stays) are dropped and
    counted; header names the table does not know are reported.
    """
    key, cleaners = TABLES[table]
    split = _lines(pulls, table)
    lines = split.select("pull_id", "header", F.posexplode("body").alias("line_no", "line")).withColumn(
        "fields", csv_fields(F.col("line")))
    field = lambda name: F.get("fields", F.array_position("header", name).cast("int") - 1)
    present = lambda name: F.when(F.array_position("header", name) > 0, field(name))
    wide = F.size("fields") == F.size("header")
    typed = lines.filter(wide).select(
        "pull_id", "line_no", *[clean(present(name)).alias(name) for name, clean in cleaners.items()])
    keyed = typed.dropna(subset=key)
    rows = first_per_key(keyed, ["pull_id", *key], "line_no").drop("line_no")

    unknown = F.array_except("header", F.array(*[F.lit(c) for c in cleaners]))
    kept = rows.groupBy("pull_id").agg(F.count("*").alias("row_count"))
    audit = split.select("pull_id", "resplit", F.size("body").alias("line_count"), unknown.alias("unknown")).join(
        kept, "pull_id", "left").select(
        "pull_id", F.coalesce("row_count", F.lit(0)).alias("row_count"),
        (F.col("line_count") - F.coalesce("row_count", F.lit(0))).alias("bad_rows"), "resplit",
        F.array_join("unknown", ",").alias("unknown_columns"))
    return rows, audit
