"""File sources and sinks: JSON, CSV, Markdown, and a response cache with a lifetime."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.functions.scope import portable

CORRUPT = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: StructType, optional: bool = False, lineage: bool = False) -> DataFrame:
    """JSON arrays of objects, or one object per line, from one file or a glob, with an explicit schema.

    optional: a path that matches nothing is an empty relation. lineage: adds `source_file`, and keeps records that do
    not parse in `_corrupt_record` instead of dropping them.
    """
    if optional and not _exists(spark, path):
        df = spark.createDataFrame([], schema)
        return df.withColumn("source_file", F.lit(None).cast("string")).withColumn(CORRUPT, F.lit(None).cast("string")) if lineage else df
    if not lineage:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("source_file", F.col("_metadata.file_name"))


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header line; a byte order mark is dropped; all strings unless a schema is given."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader).csv(path)


def concept_rules(path: str) -> tuple[list[tuple[str, str]], dict[str, list[str]]]:
    """(rules, modules) of a concept dictionary: JSON with `concepts` (id, name, priority, patterns) and `modules` (name,
    concepts by id). rules are for expr.first_match, in order of priority, letter case ignored; modules name concepts."""
    with open(path, encoding="utf-8") as f:
        book = json.load(f)
    ordered = sorted(book["concepts"], key=lambda c: c["priority"])
    names = {c["id"]: c["name"] for c in ordered}
    return [(c["name"], portable("(?i)" + "|".join(f"(?:{p})" for p in c["patterns"]))) for c in ordered], {m["name"]: [names[i] for i in m["concepts"]] for m in book.get("modules", [])}


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, nulls kept; in parallel."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_text(rows: Sequence[Mapping], pretty: bool = True) -> str:
    """JSON of a few rows, characters as they are, '\\n' line ends."""
    return json.dumps([dict(r) for r in rows], ensure_ascii=False, indent=2 if pretty else None)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), bom: bool = True, mode: str = "errorifexists") -> None:
    """CSV sorted by the given columns, in parallel range partitions; every part has the header, and where bom is set
    the byte order mark before the first column's name. One file for a spreadsheet is write_csv_file."""
    out = df.orderBy(*order) if order else df
    if bom:
        out = out.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def write_csv_file(df: DataFrame, path: str, order: Sequence[str] = (), bom: bool = True) -> int:
    """One CSV file, sorted by the given columns, with a byte order mark before the header and '\\n' line ends; returns the
    number of rows. For reports that a spreadsheet opens: rows pass through the driver one partition at a time, so
    memory is that of one partition; write_csv is for tables."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    held, rows = io.StringIO(newline=""), 0
    writer = csv.writer(held, lineterminator="\n")

    def flush() -> None:
        out.write(bytearray(held.getvalue().encode("utf-8")))
        held.seek(0)
        held.truncate()

    try:
        held.write("\ufeff" if bom else "")
        writer.writerow(df.columns)
        for row in (df.orderBy(*order) if order else df).toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            rows += 1
            if rows % 10_000 == 0:
                flush()
        flush()
    finally:
        out.close()
    return rows


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """Pipe table of a report; a report is small, so a longer table is an error rather than a silent cut."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a report of more than {max_rows} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "/").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def redacted(df: DataFrame, drop: Sequence[str], doi: str = "doi", keyword: str | None = None, abstract: str | None = None) -> DataFrame:
    """Public form: columns dropped, a DOI with markup blanked, and a keyword field blanked that holds the abstract.

    The keyword counts as holding it if, without white space and punctuation and longer than 300 characters, its first
    200 characters occur in the abstract. Refuses input that is already public.
    """
    if drop and not any(c in df.columns for c in drop):
        raise ValueError("the input is already redacted")
    out = df
    if keyword and abstract:
        norm = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)[\s\p{P}]+", "")
        out = out.withColumn(keyword, F.when((F.length(norm(keyword)) > 300) & norm(abstract).contains(F.substring(norm(keyword), 1, 200)), "").otherwise(F.col(keyword)))
    if doi in out.columns:
        out = out.withColumn(doi, F.when(F.col(doi).contains("<"), "").otherwise(F.col(doi)))
    return out.drop(*drop)


def append_log(df: DataFrame, path: str) -> None:
    """Audit log: rows appended with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def cache_key(api: str, params: Mapping[str, Column]) -> Column:
    """sha256 of the api and its parameters in order of their names."""
    pairs = [F.concat(F.lit(k + "="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(params.items())]
    return F.sha2(F.concat_ws("&", F.lit(api), *pairs), 256)


def cache_state(requests: DataFrame, cache: DataFrame, key: str, fetched_at: str, now: Column, days: int = 30) -> DataFrame:
    """requests with state hit, expired or miss: the youngest cached response within the lifetime is a hit."""
    young = cache.groupBy(key).agg(F.max(fetched_at).alias("fetched"))
    state = F.when(F.col("fetched").isNull(), "miss").when(F.col("fetched") > now - F.expr(f"INTERVAL {int(days)} DAYS"), "hit").otherwise("expired")
    return requests.join(young, key, "left").withColumn("state", state)


def put_cache(cache: DataFrame, responses: DataFrame, key: str, ok: str) -> DataFrame:
    """The cache with successful responses added; failed ones are not kept."""
    fresh = responses.where(F.col(ok)).drop(ok)
    return cache.join(fresh.select(key), key, "left_anti").unionByName(fresh)
