"""Redaction of host names, addresses, set names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose text is sensitive, in lower case, by how it is replaced.
HOST_KEYS = ("hostname", "host", "me", "primary", "syncingto", "syncsourcehost")
SET_KEYS = ("setname", "set", "replsetname")
PATH_KEYS = ("dbpath", "path", "config", "keyfile", "cafile", "pemkeyfile", "clusterfile", "clustercafile")
NAME_KEY = "name"
SENSITIVE_KEYS = (*HOST_KEYS, *SET_KEYS, NAME_KEY, *PATH_KEYS)
#: Path segments that tell nothing, and text that marks a cluster's.
SYSTEM_SEGMENTS = ("srv", "var", "lib", "etc", "pki", "tls", "certs", "private", "mongodb", "data", "home", "diagnostic.data")
CLUSTER_MARKS = ("shard", "-node", "node-", "cluster", "repl", "rs0", "rs1", "rs2")
AUTOMATION_DIRECTORY = "mongodb-mms-automation"

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP_PATTERN = rf"^({_OCTET}\.){{3}}{_OCTET}(/(3[0-2]|[12]?\d))?$"
HOST_PORT_PATTERN = r"^([A-Za-z0-9][A-Za-z0-9._-]*):(\d{1,5})$"
HOSTNAME_PATTERN = r"^[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$"


def _digest(value: Column) -> Column:
    return F.substr(F.sha2(value, 256), F.lit(1), F.lit(8))


def redact_hostname(value: Column) -> Column:
    """``host-<8 hex>.local``, from the text's SHA-256."""
    return F.concat(F.lit("host-"), _digest(value), F.lit(".local"))


def redact_ip(value: Column) -> Column:
    """``10.a.b.c`` with the first three bytes of the text's SHA-256."""
    byte = lambda i: F.conv(F.substr(F.sha2(value, 256), F.lit(2 * i + 1), F.lit(2)), 16, 10)
    return F.concat_ws(".", F.lit("10"), byte(0), byte(1), byte(2))


def redact_replset(value: Column) -> Column:
    return F.concat(F.lit("rs-"), _digest(value))


def looks_like_ip(value: Column) -> Column:
    """Four parts of 0-255, maybe a prefix length."""
    return value.rlike(IP_PATTERN)


def looks_like_host_port(value: Column) -> Column:
    return value.rlike(HOST_PORT_PATTERN)


def redact_host_port(value: Column) -> Column:
    """The host replaced as an address or a name, the port kept."""
    host = F.regexp_extract(value, HOST_PORT_PATTERN, 1)
    return F.concat(F.when(looks_like_ip(host), redact_ip(host)).otherwise(redact_hostname(host)), F.lit(":"), F.regexp_extract(value, HOST_PORT_PATTERN, 2))


def is_cluster_like(segment: Column) -> Column:
    low = F.lower(segment)
    found = low == AUTOMATION_DIRECTORY
    for mark in CLUSTER_MARKS:
        found = found | low.contains(mark)
    return found


def is_cluster_path(value: Column) -> Column:
    """Begins with ``/`` and some segment names a cluster."""
    return value.startswith("/") & F.exists(F.split(value, "/"), is_cluster_like)


def redact_path(value: Column) -> Column:
    """The path with segments that name a cluster replaced by ``server-<8 hex>``; a last segment with a dot is a file and stays."""
    parts = F.split(value, "/")
    replaced = lambda s, i: F.when((s == "") | ((i == F.size(parts) - 1) & s.contains(".")) | F.lower(s).isin(*SYSTEM_SEGMENTS) | ~is_cluster_like(s), s).otherwise(F.concat(F.lit("server-"), _digest(s)))
    return F.array_join(F.transform(parts, replaced), "/")


def redact_text(value: Column, key: str) -> Column:
    """A string by its key: what its shape tells goes first, then the key's own way."""
    key = key.lower()
    if key not in SENSITIVE_KEYS:
        return F.when(looks_like_ip(value), redact_ip(value)).when(is_cluster_path(value), redact_path(value)).otherwise(value)
    if key in HOST_KEYS:
        own = redact_hostname(value)
    elif key in SET_KEYS:
        own = redact_replset(value)
    elif key == NAME_KEY:
        own = F.when(value.rlike(HOSTNAME_PATTERN), redact_hostname(value)).otherwise(value)
    else:
        own = redact_path(value)
    return F.when((value == "") | value.isNull(), value).when(looks_like_host_port(value), redact_host_port(value)).when(looks_like_ip(value), redact_ip(value)).otherwise(own)


def _redacted(value: Column, kind: T.DataType, key: str) -> Column:
    if isinstance(kind, T.StringType):
        return redact_text(value, key)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_redacted(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redacted(x, kind.elementType, key))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _below_key(v, kind.valueType, F.lower(k.cast("string"))))
    return value


def _below_key(value: Column, kind: T.DataType, key: Column) -> Column:
    """A map's value: its strings, also those in arrays, by the map's key; fields and keys below it count themselves."""
    if isinstance(kind, T.StringType):
        return _by_key(key, value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _below_key(x, kind.elementType, key))
    return _redacted(value, kind, "")


def _by_key(key: Column, value: Column) -> Column:
    out = redact_text(value, "")
    for keys in (HOST_KEYS, SET_KEYS, (NAME_KEY,), PATH_KEYS):
        out = F.when(key.isin(*keys), redact_text(value, keys[0])).otherwise(out)
    return out


def redact(df: DataFrame) -> DataFrame:
    """Every string of ``df``, however deep, by the name of the field that holds it; other values stay."""
    return df.select(*(_redacted(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields))


def redaction_map(df: DataFrame, column: str, key: str) -> DataFrame:
    """original, replacement: the distinct values of a column that redaction changes."""
    distinct = df.select(F.col(column).alias("original")).where("original is not null").distinct()
    return distinct.withColumn("replacement", redact_text(F.col("original"), key)).where("original <> replacement")


def redact_dataset(df: DataFrame, path: str) -> None:
    """Write ``df`` redacted, as Parquet."""
    redact(df).write.mode("errorifexists").parquet(path)


def redact_tree(spark: SparkSession, folder: str, schema: T.StructType, path: str) -> DataFrame:
    """Write the JSON-lines files below ``folder`` redacted, as Parquet; returns the files that were skipped.

    A file with a line that cannot be read is skipped whole, the others are
    written; file, bad_lines of each skipped one are returned, for the log.
    """
    marked = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).where("value <> ''")
    read = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.select(F.col("_metadata.file_path").alias("__file"), read.alias("doc"))
    skipped = rows.where("doc.__corrupt is not null").groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("bad_lines"))
    good = rows.join(skipped.select(F.col("file").alias("__file")), "__file", "left_anti")
    redact_dataset(good.select(*(F.col(f"doc.`{f.name}`").alias(f.name) for f in schema.fields)), path)
    return skipped
