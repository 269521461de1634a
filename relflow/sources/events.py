"""World-event files: 58 tab-separated columns, no header (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference: field layout of the event file, in file order.
# Two actor groups of ten fields and three geo groups of seven, flattened as
# "<group>_<field>".
ACTOR_FIELDS = [("code", "string"), ("name", "string"), ("countryCode", "string"),
                ("knownGroupCode", "string"), ("ethnicCode", "string"), ("religion1Code", "string"),
                ("religion2Code", "string"), ("type1Code", "string"), ("type2Code", "string"),
                ("type3Code", "string")]
GEO_FIELDS = [("type", "int"), ("name", "string"), ("countryCode", "string"), ("adm1Code", "string"),
              ("lat", "double"), ("long", "double"), ("featureId", "int")]
TOP_LEVEL = [("globalEventID", "int"), ("day", "date"), ("month", "int"), ("year", "int"),
             ("fracDate", "double"), ("actor1Code", ACTOR_FIELDS), ("actor2Code", ACTOR_FIELDS),
             ("isRoot", "boolean"), ("eventCode", "string"), ("eventBaseCode", "string"),
             ("eventRootCode", "string"), ("quadClass", "int"), ("goldstein", "double"),
             ("numMentions", "int"), ("numSources", "int"), ("numArticles", "int"),
             ("avgTone", "double"), ("actor1Geo", GEO_FIELDS), ("actor2Geo", GEO_FIELDS),
             ("eventGeo", GEO_FIELDS), ("dateAdded", "date"), ("sourceUrl", "string")]
DATE_FORMAT = "yyyyMMdd"

_TYPES = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
          "date": T.DateType(), "boolean": T.BooleanType()}


def event_columns() -> list[tuple[str, str]]:
    cols = []
    for name, typ in TOP_LEVEL:
        if isinstance(typ, list):
            cols += [(f"{name}_{child}", ct) for child, ct in typ]
        else:
            cols.append((name, typ))
    return cols


def event_schema() -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in event_columns()])


def _raw_schema() -> T.StructType:
    # booleans are read as text: true iff the field is exactly "1"
    return T.StructType([T.StructField(n, T.StringType() if t == "boolean" else _TYPES[t], True)
                         for n, t in event_columns()])


def _reader(reader, mode: str):
    return (reader.schema(_raw_schema())
            .option("sep", "\t").option("header", "false").option("lineSep", "\n")
            .option("quote", "\u0000").option("escape", "\u0000")
            .option("dateFormat", DATE_FORMAT)
            .option("encoding", "UTF-8")
            .option("mode", mode)
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .option("nullValue", "").option("emptyValue", ""))


def _finish(df: DataFrame) -> DataFrame:
    cols = []
    for n, t in event_columns():
        if t == "boolean":
            cols.append((F.col(n) == F.lit("1")).alias(n))
        elif t == "string":
            # a trailing carriage return of a CRLF line lands in the last field
            cols.append(F.regexp_replace(F.col(n), "\r$", "").alias(n) if n == "sourceUrl" else F.col(n))
        else:
            cols.append(F.col(n))
    return df.select(*cols)


def read_events(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Batch read of event files (A1). A field that does not parse becomes null
    on its own; missing trailing fields are null, surplus fields ignored, blank
    lines skipped. ``mode="FAILFAST"`` rejects malformed lines instead."""
    return _finish(_reader(spark.read, mode).csv(path))


def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                  mode: str = "PERMISSIVE") -> DataFrame:
    """The same format as a file stream (A2)."""
    r = _reader(spark.readStream, mode)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _finish(r.csv(path))
