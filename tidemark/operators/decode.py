"""Envelopes and Avro bodies: decode, split off errors, encode, route to topics, and frame for live channels.

An envelope is CloudEvents JSON whose body is base64 (which wins) or text. All checks are built-in expressions; only the
Avro body itself runs in Python, by Arrow batches, since the avro package is not part of plain PySpark.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import scalars as S

TYPES = {f"com.dex.events.{k.lower()}": k for k in schemas.EVENTS}
LIQUIDITY_TYPES = [t for t, k in TYPES.items() if k != "Swap"]
#: Categories of what can be wrong with a message (fixed values). Schemas are part of the program here, so SCHEMA_LOAD never occurs.
INVALID, PAYLOAD, BASE64, TYPE, AVRO = "INVALID_ENVELOPE", "PAYLOAD_EXTRACTION", "BASE64_DECODE", "UNSUPPORTED_EVENT_TYPE", "AVRO_DECODE"
MAPPING, SCHEMA, UNKNOWN = "FIELD_MAPPING", "SCHEMA_LOAD", "UNKNOWN"
TRADING_TOPIC, LIQUIDITY_TOPIC = "dex-trading-events", "dex-liquidity-events"
PREVIEW = 16


def _checked(value: Column, v: Column) -> Column:
    """type, body and error of an envelope from its bytes and its parsed JSON."""
    top = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))
    return F.struct(F.schema_of_variant(v).alias("whole"), kind("specversion").alias("version"), kind("data_base64").alias("k64"), kind("data").alias("kdata"), top("type").alias("type"), F.try_to_binary(top("data_base64"), F.lit("base64")).alias("b64"), top("data").alias("data"), F.coalesce(F.length(value), F.lit(0)).alias("size"))


def _judged(e: Column) -> Column:
    has64 = e["k64"] != "VOID"
    error = (
        F.when(e["size"] == 0, INVALID)
        .when(~F.coalesce(F.startswith(e["whole"], F.lit("OBJECT")), F.lit(False)), INVALID)
        .when(e["version"] == "VOID", INVALID)
        .when(has64 & e["b64"].isNull(), BASE64)
        .when(~has64 & (e["kdata"] != "STRING"), PAYLOAD)
    )
    body = F.when(has64, e["b64"]).otherwise(F.encode(e["data"], "ISO-8859-1"))
    return F.struct(F.coalesce(e["type"], F.lit("")).alias("type"), error.alias("error"), body.alias("body"))


def _once(value: Column, body) -> Column:
    """Evaluates value once for all its uses in body; fields of a plain struct would be worked out again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw with type, body (binary), and error (a category, or null). The checks come in a fixed order; the first to fail names the error."""
    text = F.col(value).cast("string")
    parsed = F.try_parse_json(F.when(F.is_valid_utf8(text), text))
    judged = _once(_once(parsed, lambda v: _checked(F.col(value), v)), _judged)
    out = raw.select("*", F.explode(F.array(judged)).alias("_j"))  # one row of each; a plain column would be worked out anew at each use of a field
    return out.select("*", F.col("_j.type").alias("type"), F.col("_j.error").alias("error"), F.when(F.col("_j.error").isNull(), F.col("_j.body")).alias("body")).drop("_j")


def route(parsed: DataFrame, stream: str) -> DataFrame:
    """Checks the type for a stream (trading or liquidity): another type is an error, a blank one on liquidity an invalid envelope. Envelopes with an empty body are dropped."""
    trading = stream == "trading"
    wanted = F.col("type").isin("com.dex.events.swap") if trading else F.col("type").isin(*LIQUIDITY_TYPES)
    error = F.when(F.col("error").isNotNull(), F.col("error"))
    if not trading:
        error = error.when(F.trim("type") == "", INVALID)
    error = error.when(~wanted, TYPE)
    out = parsed.withColumn("error", error).withColumn("eventType", F.when(F.col("error").isNull(), F.initcap(F.substring_index("type", ".", -1))))
    return out.where("error is not null or length(body) > 0")


def error_rows(decoded: DataFrame, stream: str, failed_at: int, value: str = "value") -> DataFrame:
    """Error records of a stream: size and hexadecimal start of the message, and the category."""
    raw = F.col(value).cast("binary")
    return decoded.where("error is not null").select(
        F.lit(stream).alias("stream"), F.col("error").alias("reason"), F.coalesce(F.length(raw), F.lit(0)).alias("payloadSize"),
        F.coalesce(S.hex_preview(raw, PREVIEW), F.lit("")).alias("payloadPreview"), F.col("error").alias("category"), F.lit(failed_at).cast("long").alias("failedAt"),
    )


def _read_long(raw: bytes, at: int) -> tuple[int, int]:
    shift = out = 0
    while True:
        byte = raw[at]
        out |= (byte & 0x7F) << shift
        at += 1
        if not byte & 0x80:
            return (out >> 1) ^ -(out & 1), at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def _write_long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def avro_decode(raw: bytes, schema: T.StructType) -> dict:
    """A flat record in Avro binary; bytes after it are ignored."""
    at, out = 0, {}
    for field in schema.fields:
        if field.name in schemas.OPTIONAL:
            branch, at = _read_long(raw, at)
            if branch not in (0, 1):
                raise ValueError("no such branch")
            if branch == 0:
                out[field.name] = None
                continue
        if isinstance(field.dataType, T.StringType):
            size, at = _read_long(raw, at)
            if size < 0 or at + size > len(raw):
                raise ValueError("a text ends after the record")
            out[field.name] = raw[at : at + size].decode()
            at += size
        elif isinstance(field.dataType, T.DoubleType):
            (out[field.name],) = struct.unpack_from("<d", raw, at)
            at += 8
        else:
            out[field.name], at = _read_long(raw, at)
            if isinstance(field.dataType, T.IntegerType) and not -(1 << 31) <= out[field.name] < 1 << 31:
                raise ValueError("a number does not fit")
    return out


def avro_encode(record: dict, schema: T.StructType) -> bytes:
    out = bytearray()
    for field in schema.fields:
        value = record[field.name]
        if field.name in schemas.OPTIONAL:
            value = None if value is None or value != value else value
            out += _write_long(0 if value is None else 1)
            if value is None:
                continue
        if isinstance(field.dataType, T.StringType):
            text = value.encode()
            out += _write_long(len(text)) + text
        elif isinstance(field.dataType, T.DoubleType):
            out += struct.pack("<d", value)
        else:
            out += _write_long(int(value))
    return bytes(out)


def _fields(kinds: list[str]) -> T.StructType:
    """The columns of all these kinds of events."""
    return T.StructType(list({f.name: f for k in kinds for f in schemas.EVENTS[k].fields}.values()))


def _decoder(kinds: list[str]):
    fields = _fields(kinds)

    @F.pandas_udf(T.StructType([*fields.fields, T.StructField("failed", T.StringType())]))
    def decode(types: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        columns, failed = {name: [] for name in fields.names}, []
        for kind, raw in zip(types, bodies, strict=True):
            record, reason = {}, None
            try:
                record = {} if raw is None else avro_decode(raw, schemas.EVENTS[kind])
            except (ValueError, IndexError, struct.error):
                reason = AVRO
            except Exception:  # noqa: BLE001 one message must not end a job
                reason = UNKNOWN
            for name, column in columns.items():
                column.append(record.get(name))
            failed.append(reason)
        return pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in {**columns, "failed": failed}.items()})

    # Else Spark runs it once more for each filter on what it gives.
    return decode.asNondeterministic()


def decoded(raw: DataFrame, stream: str, value: str = "value") -> DataFrame:
    """The messages of a stream (column _message) with _error (null if there is none), eventType, and the columns of all its kinds
    of events, from one pass over them: a message is parsed once, and its body decoded once."""
    routed = route(parse_envelopes(raw, value), stream)
    kinds = ["Swap"] if stream == "trading" else ["Mint", "Burn", "Transfer"]
    body = F.when(F.col("eventType").isin(*kinds) & F.col("error").isNull(), F.col("body"))
    rows = routed.select(F.col(value).alias("_message"), F.col("error").alias("_error"), "eventType", _decoder(kinds)(F.col("eventType"), body).alias("_record"))
    of = lambda name: F.col(f"_record.{name}")
    failed = F.coalesce("_error", of("failed"))
    return rows.select("_message", failed.alias("_error"), F.when(failed.isNull(), F.col("eventType")).alias("eventType"), *[of(name).alias(name) for name in _fields(kinds).names], F.timestamp_seconds(of("blockTimestamp")).alias("event_time"))


def split(decoded_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wide events, value and error of the rest) of decoded messages."""
    good, bad = decoded_rows.where("_error is null"), decoded_rows.where("_error is not null")
    return good.drop("_message", "_error"), bad.select(F.col("_message").alias("value"), F.col("_error").alias("error"))


def events_from(raw: DataFrame, stream: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(wide events, rows with errors) of a stream of envelopes."""
    return split(decoded(raw, stream, value))


def encode_bodies(events: DataFrame, kind: str) -> DataFrame:
    """Events of one type with `body`, their Avro binary form, and `encodeError`: FIELD_MAPPING where a required value is missing
    or does not fit (null if there is none); such events have no body."""
    schema = schemas.EVENTS[kind]

    @F.pandas_udf("body binary, failed string")
    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        bodies, failed = [], []
        for record in frame.to_dict("records"):
            body = reason = None
            try:
                body = avro_encode(record, schema)
            except (ValueError, TypeError, AttributeError, OverflowError, struct.error):
                reason = MAPPING
            bodies.append(body)
            failed.append(reason)
        return pd.DataFrame({"body": pd.Series(bodies, dtype=object), "failed": pd.Series(failed, dtype=object)})

    # Told to be nondeterministic, as it would else run once more for each filter on what it gives.
    made = events.where(F.col("eventType") == kind).withColumn("_e", encode.asNondeterministic()(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])))
    return made.withColumns({"body": F.col("_e.body"), "encodeError": F.col("_e.failed")}).drop("_e")


def encoded(events: DataFrame) -> DataFrame:
    """Events of all types with body and encodeError."""
    out = None
    for kind in schemas.EVENTS:
        rows = encode_bodies(events, kind)
        out = rows if out is None else out.unionByName(rows)
    return out


def envelopes(encoded: DataFrame, source: str = "ingester") -> DataFrame:
    """key (the pool), topic, and value (the envelope as JSON) of encoded events, without those that could not be encoded."""
    fields = [
        F.lit("1.0").alias("specversion"), F.col("eventId").alias("id"), F.lit(source).alias("source"), S.cloud_event_type(F.col("eventType")).alias("type"),
        F.lit("application/avro").alias("datacontenttype"), F.col("pairAddress").alias("subject"), S.rfc3339(F.col("eventTimestamp")).alias("time"), F.base64("body").alias("data_base64"),
    ]
    return encoded.where("body is not null").select(F.col("pairAddress").alias("key"), topic_of(F.col("eventType")).alias("topic"), F.to_json(F.struct(*fields)).alias("value"))


def topic_of(kind: Column) -> Column:
    """Swaps go to the trading topic, liquidity events to theirs, anything else nowhere (null)."""
    return F.when(kind == "Swap", TRADING_TOPIC).when(kind.isin("Mint", "Burn", "Transfer"), LIQUIDITY_TOPIC)


def to_json_records(table: DataFrame) -> DataFrame:
    """Result rows as JSON text with nulls written out."""
    return table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


CHANNELS = ("trading", "liquidity", "alerts", "trends")


def wanted_channels(message: str | None) -> list[str]:
    """Channels whose names stand anywhere in a client's message, whatever the case; none named means all."""
    text = (message or "").lower()
    return [c for c in CHANNELS if c in text] or list(CHANNELS)


def channel_frames(tables: dict[str, DataFrame], message: str | None = None) -> DataFrame:
    """channel, pair and frame (JSON with channel, pair and data) for live clients."""
    out = None
    for channel in wanted_channels(message):
        if channel in tables:
            table = tables[channel]
            frame = F.to_json(F.struct(F.lit(channel).alias("channel"), F.col("pairAddress").alias("pair"), F.struct(*table.columns).alias("data")), {"ignoreNullFields": "false"})
            rows = table.select(F.lit(channel).alias("channel"), F.col("pairAddress").alias("pair"), frame.alias("frame"))
            out = rows if out is None else out.unionByName(rows)
    return out


def results_from(raw: DataFrame, topic: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of envelopes that carry results of a topic; unknown fields are ignored, missing ones are null."""
    schema = schemas.RESULTS[topic]
    data = F.get_json_object(F.col(value).cast("string"), "$.data")
    parsed = raw.withColumn("_r", F.from_json(data, schema)).withColumn("error", F.when(F.try_parse_json(F.col(value).cast("string")).isNull(), "not JSON").when(data.isNull(), "no data").when(F.from_json(data, schema).getField(schema[0].name).isNull(), "not a result"))
    return parsed.where("error is null").select("_r.*"), parsed.where("error is not null").select(F.col(value).alias("value"), "error")
