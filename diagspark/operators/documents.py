"""Documents of unknown schema, as VARIANT or JSON text: numeric paths and redaction.

A document is taken apart inside its row, so nothing is shuffled: a VARIANT
level by level, for which the number of levels is measured on the data first;
a JSON text for numeric paths in one go.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.captures import CAPTURE_PREFIXES, capture_documents, load_captures
from .redact import HOST_KEYS, NAME_KEY, PATH_KEYS, SET_KEYS, redact_text

_OBJECT, _LIST = "map<string,variant>", "array<variant>"
_ENTRIES = "array<struct<key:string,value:variant>>"


def nesting(text: Column) -> Column:
    """How deep objects and lists lie in each other in a JSON text; a scalar is 0."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deeper = lambda at, c: F.when(c.isin("{", "["), at["now"] + 1).when(c == "", at["now"]).otherwise(at["now"] - 1)
    step = lambda at, c: F.struct(deeper(at, c).alias("now"), F.greatest(at["most"], deeper(at, c)).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, step, lambda at: at["most"])


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def depth(df: DataFrame, column: str) -> int:
    """The deepest nesting of a column of documents: one number to the driver."""
    text = F.col(column) if _is_text(df, column) else F.to_json(column)
    return df.select(nesting(text).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("d")).first()["d"]


def _children(value: Column) -> Column:
    """Key (or place) and value of each member of an object or list; null for a scalar."""
    members = F.map_entries(F.try_variant_get(value, "$", _OBJECT))
    places = F.transform(F.try_variant_get(value, "$", _LIST), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    return F.coalesce(members.cast(_ENTRIES), places.cast(_ENTRIES))


def _number(value: Column) -> Column:
    """A numeric leaf as a whole number: fractions cut off, booleans 0 or 1, times in milliseconds; null for all else."""
    kind = F.schema_of_variant(value)
    whole = F.when(kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|BOOLEAN|FLOAT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(value, "$", "bigint"))
    return whole.when(kind.startswith("TIMESTAMP"), F.unix_millis(F.try_variant_get(value, "$", "timestamp")))


def _levels(start: Column, steps: int, open_up: Callable[[Column], Column]) -> Column:
    """``start`` with every nested entry replaced by its members, again and again, in the order of the document."""
    found = start
    for _ in range(steps):
        found = F.flatten(F.transform(found, open_up))
    return found


def _first_of_paths(leaves: Column) -> Column:
    """Of entries with one path the first; documents without such are left as they are."""
    paths = F.transform(leaves, lambda x: x["path"])
    first = F.filter(leaves, lambda x, i: F.array_position(paths, x["path"]) == i + 1)
    return F.when(F.size(F.array_distinct(paths)) < F.size(paths), first).otherwise(leaves)


def _whole_number(text: str) -> int | None:
    """A JSON integer; null for one that has too many digits for 64 bits."""
    return int(text) if len(text) <= 20 else None


def _cut_number(text: str) -> int | None:
    """A JSON number with a fraction or an exponent, cut off as Spark's decimals (38 digits) and doubles are; null for one beyond them."""
    if "e" not in text and "E" not in text:
        exact = Decimal(text)
        if len(text) <= 38 or len(exact.as_tuple().digits) <= 38 and -exact.as_tuple().exponent <= 38:
            return int(exact)
    value = float(text)
    return int(value) if abs(value) <= 1 << 63 else None


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


#: Objects become tuples of their pairs, so that order and repeated keys are kept.
_JSON = json.JSONDecoder(object_pairs_hook=tuple, parse_int=_whole_number, parse_float=_cut_number, parse_constant=_no_number)


def _numeric_paths(text: str | None) -> dict[str, int]:
    """The numeric leaves of a JSON text by path, of a path that comes twice the first; what follows an object or list is passed over, as by Spark's parser."""
    text = (text or "").lstrip(" \t\r\n")
    try:
        value, end = _JSON.raw_decode(text)
    except (ValueError, RecursionError):
        return {}
    if type(value) not in (tuple, list) and text[end : end + 1].strip(" \t\r\n"):
        return {}
    found: dict[str, int] = {}
    waiting = [("", value)]
    while waiting:
        path, value = waiting.pop()
        kind = type(value)
        if kind is tuple or kind is list:
            before = f"{path}/" if path else ""
            waiting += [(f"{before}{name}", x) for name, x in reversed(value if kind is tuple else list(enumerate(value)))]
        elif (kind is int or kind is bool) and -1 << 63 <= value < 1 << 63:
            found.setdefault(path.encode("utf-8", "replace").decode(), int(value))
    return found


def _text_leaves(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        paths: list[str] = []
        values: list[int] = []
        ends = [0]
        for text in batch:
            found = _numeric_paths(text.as_py())
            paths += found
            values += found.values()
            ends.append(len(paths))
        leaves = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.int64())], ["path", "value"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaves)


def flatten_documents(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """keys, path, value: the numeric leaves of documents whose shapes differ.

    ``column`` is VARIANT or JSON text. Steps are joined by ``/``, a list's
    place is a step, booleans are 0 or 1, fractions are cut off, times are
    milliseconds; strings, nulls and numbers beyond 64 bits are dropped. Of a
    path that comes twice the first counts, also where a text has a key twice.
    A text that is no JSON, and a null, give no rows. Texts are read once, in
    one pass, however deep they nest.
    """
    if _is_text(df, column):
        leaves = F.arrow_udf(_text_leaves, "array<struct<path:string,value:bigint>>")(column)
    else:
        join = lambda p, name: F.when(p == "", name).otherwise(F.concat(p, F.lit("/"), name))
        start = F.array(F.struct(F.lit("").alias("path"), F.col(column).alias("value")))

        def members(e: Column) -> Column:
            return F.coalesce(F.transform(_children(e["value"]), lambda x: F.struct(join(e["path"], x["key"]).alias("path"), x["value"].alias("value"))), F.array(e))

        numbers = F.transform(_levels(start, depth(df, column), members), lambda e: F.struct(e["path"].alias("path"), _number(e["value"]).alias("value")))
        leaves = _first_of_paths(F.filter(numbers, lambda x: x["value"].isNotNull()))
    return df.select(*keys, F.explode(leaves).alias("x")).select(*keys, "x.path", "x.value")


def _by_key(value: Column, key: Column) -> Column:
    """A string redacted as its key (in lower case) asks for."""
    out = redact_text(value, "")
    for keys in (HOST_KEYS, SET_KEYS, (NAME_KEY,), PATH_KEYS):
        out = F.when(key.isin(*keys), redact_text(value, keys[0])).otherwise(out)
    return out


def redacted_document(document: Column, levels: int, key: Column | None = None) -> Column:
    """A VARIANT with its strings redacted, ``levels`` deep; objects and lists keep their shape."""
    key = F.lit("") if key is None else key
    # Strings are the only scalars that redaction touches.
    string = F.try_variant_get(document, "$", "string")
    scalar = F.when(F.schema_of_variant(document) == "STRING", _by_key(string, key).cast("variant")).otherwise(document)
    if not levels:
        return scalar
    entries, is_object = _children(document), F.try_variant_get(document, "$", _OBJECT).isNotNull()
    done = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), redacted_document(e["value"], levels - 1, F.when(is_object, F.lower(e["key"])).otherwise(key)).alias("value")))
    values = lambda n: F.to_variant_object(F.transform(n, lambda e: e["value"]))
    # Through a list of one, so that the members stand in the plan once.
    built = F.transform(F.array(done), lambda n: F.when(is_object, F.to_variant_object(F.map_from_entries(n))).otherwise(values(n)))[0]
    return F.when(entries.isNull(), scalar).otherwise(built)


def redact_documents(df: DataFrame, column: str) -> DataFrame:
    """``df`` with every string of a VARIANT or JSON-text column redacted by the key that holds it.

    A list's strings count under the list's key; numbers, booleans and nulls
    stay. The kind of column stays. A text that is no JSON, or has a key
    twice in one object, becomes null.
    """
    levels, text = depth(df, column), _is_text(df, column)
    parsed = df.withColumn("__document", F.try_parse_json(column) if text else F.col(column))
    done = redacted_document(F.col("__document"), levels)
    return parsed.withColumn(column, F.to_json(done) if text else done).drop("__document")


def redacted_and_skipped(lines: DataFrame, path: str, file: str = "file", column: str = "document") -> DataFrame:
    """Write the redacted lines of all files that can be read whole, as Parquet; returns file, bad_lines of the others."""
    bad = F.try_parse_json(column).isNull()
    skipped = lines.where(bad).groupBy(file).agg(F.count("*").alias("bad_lines"))
    redact_documents(lines.join(skipped.select(file), file, "left_anti"), column).write.mode("errorifexists").parquet(path)
    return skipped


def redact_document_tree(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Write all lines of JSON below ``folder``, of whatever shapes, redacted: file, document (JSON text), as Parquet.

    A file with a line that cannot be read is skipped whole; file, bad_lines of
    the skipped ones are returned, for the log.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).where("value <> ''")
    return redacted_and_skipped(lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document")), path)


def redact_captures(spark: SparkSession, inputs: str | Sequence[str], path: str, prefixes: Sequence[str] = CAPTURE_PREFIXES) -> DataFrame:
    """Write captures without clear names: ``documents`` redacted (metadata, and the first sample of each chunk), ``samples`` with all metrics and times.

    Counters hold no text, so they stay as they are. A capture with any part
    that cannot be read is skipped whole; file, error of those are returned.
    """
    told = load_captures(spark, inputs, path, prefixes=prefixes)
    documents = capture_documents(spark, inputs, prefixes)
    bad = documents.where("_corrupt is not null").select("file", F.col("_corrupt").alias("error"))
    if told["failed_chunks"]:
        chunks = spark.read.parquet(f"{path}/chunks").where("_corrupt is not null")
        bad = bad.unionByName(chunks.select("file", F.col("_corrupt").alias("error"))).groupBy("file").agg(F.max("error").alias("error"))
    good = documents.where("_corrupt is null").drop("_corrupt").join(bad.select("file"), "file", "left_anti")
    redact_documents(good, "document").write.mode("errorifexists").parquet(f"{path}/documents")
    return bad
