"""Encodings of entries: typed columns to JSON, Arrow and Parquet bytes and back, and output formats."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

JSON_TYPES: dict[str, DataType] = {"string": StringType(), "integer": IntegerType(), "boolean": BooleanType(), "number": DoubleType()}


def schema_of(json_schema: dict) -> StructType:
    """Columns for a JSON Schema object: string, integer, boolean, number; other types are refused."""
    fields = []
    for name, spec in json_schema["properties"].items():
        if spec.get("type") not in JSON_TYPES:
            raise TypeError(f"no column type for {name}: {spec.get('type')!r}")
        fields.append(StructField(name, JSON_TYPES[spec["type"]], False))
    return StructType(fields)


def encode_json(df: DataFrame, key: str, name: str = "value") -> DataFrame:
    """(key, value): all columns as one JSON object in bytes."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*df.columns)).cast("binary").alias(name))


def decode_json(entries: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """(key, columns); an ill-typed or missing field fails the query."""
    parsed = F.from_json(F.col(value).cast("string"), schema, {"mode": "FAILFAST"})
    rows = entries.select("key", parsed.alias("v"))
    missing = F.lit(False)
    for f in schema.fields:
        if not f.nullable:
            missing = missing | F.col(f"v.{f.name}").isNull()
    return rows.where(F.when(missing, F.raise_error(F.lit("a field is missing")).cast("boolean")).otherwise(F.lit(True))).select("key", "v.*")


def to_arrow_ipc(df: DataFrame, path: str) -> None:
    """Arrow IPC files, one for each partition, written by the executors."""
    import uuid

    def write(batches):
        first, sink, n = None, None, 0
        name = f"{path}/part-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if first is None:
                from pyarrow import fs

                files, at = fs.FileSystem.from_uri(name)
                files.create_dir(at.rpartition("/")[0])
                first = files.open_output_stream(at)
                sink = pa.ipc.new_file(first, batch.schema)
            sink.write_batch(batch)
            n += batch.num_rows
        if sink is not None:
            sink.close(), first.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "rows"])

    df.mapInArrow(write, "file string, rows bigint").collect()


def beside(keys: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """Key columns and value columns of one entry side by side."""
    return keys.join(values, on)


def formatted(df: DataFrame, kind: str, limit: int | None = None):
    """Rows for a driver: dict, tuples, json or csv."""
    rows = (df if limit is None else df.limit(limit)).collect()
    if kind == "dict":
        return [r.asDict(recursive=True) for r in rows]
    if kind == "tuples":
        return list(df.columns), [tuple(r) for r in rows]
    if kind == "json":
        import json

        return json.dumps([r.asDict(recursive=True) for r in rows], default=str)
    if kind == "csv":
        import csv
        import io

        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows(rows)
        return out.getvalue()
    raise ValueError("the format is dict, tuples, json or csv")
