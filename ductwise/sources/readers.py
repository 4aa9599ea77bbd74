"""Sources and sinks: sensor CSV and Parquet, JSON lines, YAML, Turtle, reports, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import NumericType, StructType

from ..functions.labels import parse_file_name

TRIPLES = "system_id string, s string, p string, o string"
#: The two time formats of sensor files.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm")


def numeric_columns(schema: StructType, exclude: tuple[str, ...] = ("fault_label", "Datetime")) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of each Parquet file, by the reader's row index (pushed to the scan as a filter)."""
    return df.where(F.col("_metadata.row_index") < n)


def read_sensor_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Sensor files with their file name; with a frozen schema no pass over the data is spent on inference."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def parse_time(column: Column) -> Column:
    """A timestamp from either format, null for anything else."""
    return F.coalesce(*(F.try_to_timestamp(column, F.lit(f)) for f in TIME_FORMATS))


def load_system(spark: SparkSession, path: str, system: str, schema: str | StructType | None = None) -> DataFrame:
    """All files of a system with fault type, intensity and label; finite numbers only, other values null."""
    rows = read_sensor_csv(spark, path, schema)
    info = parse_file_name(system, F.col("source_file"))
    out = rows.withColumn("info_", info).select(F.lit(system).alias("system_id"), *rows.columns, "info_.*")
    return out.withColumns({c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in rows.dtypes if t in ("double", "float")})


#: Values that a gap is filled over at most.
GAP = 5


def load_clean(spark: SparkSession, path: str, system: str, schema: str | StructType | None = None, order: str = "Datetime", share: float = 1.0, most_rows: int | None = None, size: int = 15, seed: int = 42) -> DataFrame:
    """``load_system`` made ready for windows: rows numbered within their file (row_idx), a share of each file, short gaps filled, columns without a value left out, labels numbered.

    A share is drawn in whole windows of ``size`` rows by md5 of file and window, so windows stay whole; ``most_rows`` keeps a file's first rows.  Gaps of at
    most ``GAP`` rows take the last value before, never across files.  label_id is 0 without a fault, else the label's place in alphabetic order.
    """
    from ..operators.statistics import drop_empty_columns, hash_order
    from ..operators.windows import forward_fill, numbered

    rows = load_system(spark, path, system, schema)
    place = [parse_time(F.col(order)), F.col(order)] if dict(rows.dtypes).get(order) == "string" else [F.col(order)]
    rows = rows.withColumn("place_", F.struct(*place))
    rows = numbered(rows, ["source_file"], ["place_"], "row_idx")
    if most_rows is not None:
        rows = rows.where(F.col("row_idx") < most_rows)
    if share < 1:
        block = F.concat_ws("|", "source_file", F.floor(F.col("row_idx") / size).cast("string"))
        rows = rows.where(F.conv(F.left(hash_order(block, seed), F.lit(8)), 16, 10).cast("long") < int(share * 16**8))
    rows = drop_empty_columns(rows)
    for c in numeric_columns(rows.schema, exclude=("fault_label", "Datetime", "row_idx", "label_id")):
        rows = forward_fill(rows, ["source_file"], ["row_idx"], c, GAP)
    free = F.col("is_fault_free")
    names = [r["label"] for r in rows.where(~free).select("label").distinct().orderBy("label").collect()]  # a row for each label
    ids = F.create_map(*(x for k, name in enumerate(["", *names]) for x in (F.lit(name), F.lit(k))))
    return rows.withColumn("label_id", F.when(free, 0).otherwise(F.try_element_at(ids, F.col("label")))).drop("place_")


def union_systems(frames: list[DataFrame]) -> DataFrame:
    """Union of frames of different columns; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_cache(df: DataFrame, path: str, by: list[str]) -> None:
    """A zstd Parquet cache partitioned by system and file; the committer makes it atomic."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def row_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file")).agg(F.count("*").alias("n_rows"))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines of a fixed schema; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_yaml(spark: SparkSession, path: str, key: str | None = None) -> dict | list:
    """A YAML document (or one of its keys) read on the driver; configurations are small."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    loaded = yaml.safe_load(text) or {}
    return loaded if key is None else loaded.get(key, [])


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` wins, nested dictionaries are merged."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_model_catalog(spark: SparkSession, pattern: str) -> DataFrame:
    """metadata.json documents of trained models, with the folder each lies in."""
    return spark.read.option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def markdown(rows: DataFrame, title: str, limit: int = 500) -> str:
    """A small table of metrics as Markdown; more rows than ``limit`` are an error, not a shorter report."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report of more than {limit} rows: aggregate further or write a table")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in got]) + "\n"


def statements(text: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) of Turtle: prefixed names and IRIs, ';' and ',' lists, 'a'; literals and blank nodes are skipped over."""
    import re

    token = re.compile(r'#[^\n]*|<[^>]*>|"""(?:.|\n)*?"""(?:@[\w-]+|\^\^\S+)?|"(?:\\.|[^"\\])*"(?:@[\w-]+|\^\^[^\s;,.]+)?|[;,\[\]()]|\.(?=\s|$)|[^\s;,\[\]()]+?(?=[\s;,\[\]()]|\.(?:\s|$)|$)')
    subject = predicate = None
    depth = 0
    skip = 0
    for m in token.finditer(text):
        t = m.group()
        if t.startswith("#"):
            continue
        if t in ("@prefix", "@base", "PREFIX", "BASE"):
            skip = 2 if t.lower().endswith("prefix") else 1
            continue
        if skip and t != ".":
            skip -= 1
            continue
        if t in "[(":
            depth += 1
        elif t in "])":
            depth -= 1
        elif depth:
            continue
        elif t == ".":
            subject = predicate = None
        elif t == ";":
            predicate = None
        elif t == ",":
            continue
        elif subject is None:
            subject = t
        elif predicate is None:
            predicate = t
        elif not t.startswith('"'):
            yield subject, predicate, t


def local_name(term: str) -> str:
    """What follows the last '#', '/' or prefix of an IRI or prefixed name; 'a' is type."""
    if term == "a":
        return "type"
    t = term.strip("<>")
    return t.rsplit("#", 1)[-1] if "#" in t else t.rsplit("/", 1)[-1] if "/" in t else t.split(":", 1)[-1]


class _File(InputPartition):
    def __init__(self, system: str, text: str):
        self.system, self.text = system, text


class TurtleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options.get("files", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [_File(k, v) for k, v in self.files.items()]

    def read(self, partition):
        for s, p, o in statements(partition.text):
            yield partition.system, local_name(s), local_name(p), local_name(o)


class TurtleSource(DataSource):
    """Python data source 'turtle': option files is a JSON object of system id to Turtle text."""

    @classmethod
    def name(cls) -> str:
        return "turtle"

    def schema(self) -> str:
        return TRIPLES

    def reader(self, schema) -> TurtleReader:
        return TurtleReader(self.options)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all Turtle files under ``path``, a task each; the system is the file's name. Any file system that Spark reads will do."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.ttl)?$", 1).alias("system_id"), "value")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([(sid, local_name(s), local_name(p), local_name(o)) for sid, text in zip(pdf["system_id"], pdf["value"]) for s, p, o in statements(text)], columns=["system_id", "s", "p", "o"])

    return files.mapInPandas(parse, TRIPLES)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, name and modification time of the files that a glob finds, from the file system's listing alone."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))


def discover(files: DataFrame, cached: DataFrame) -> DataFrame:
    """The sensor files of a system by name: its CSV files, or, where there are none, those that the cache stands for. files and cached: name, modified."""
    raw = files.where(F.lower("name").endswith(".csv")).select("name")
    stubs = cached.where(F.lower("name").endswith(".parquet")).select(F.regexp_replace("name", r"(?i)\.parquet$", ".csv").alias("name"))
    return (raw if not raw.isEmpty() else stubs).distinct().orderBy("name")


def choose_source(files: DataFrame, cached: DataFrame, use_cache: bool = True, trust_cache: bool = False) -> DataFrame:
    """name, source ('parquet' or 'csv') of files(name, modified): the cache where it is trusted, not older than its file, or all there is."""
    stem = lambda c: F.regexp_replace(c, r"(?i)\.(csv|parquet)$", "")
    a = files.select(stem("name").alias("stem"), "name", F.col("modified").alias("raw_"))
    b = cached.select(stem("name").alias("stem"), F.col("modified").alias("made_"))
    j = a.join(b, "stem", "full")
    fresh = F.col("made_").isNotNull() & (F.lit(trust_cache) | F.col("raw_").isNull() | (F.col("made_") >= F.col("raw_")))
    return j.select(F.coalesce("name", F.concat("stem", F.lit(".csv"))).alias("name"), F.when(F.lit(use_cache) & fresh, "parquet").otherwise("csv").alias("source"))


#: Scenarios as JSON lines, with the nodes of their path nested.
SCENARIO = (
    "scenario_id string, scenario_type string, description string, root_cause_system string, root_cause_node string, fault_type string, fault_intensity string, affected_systems array<string>, optimal_path array<string>, source_file string, "
    "time_window_start long, time_window_end long, difficulty string, symptom_description string, diagnostic_path struct<nodes:array<struct<node_id:string,role:string,system_id:string,component_name:string,abnormal_hint:string,direction:string>>,root_cause_node:string,fault_type:string,path_length:int>"
)


def write_scenarios(scenarios: DataFrame, path: str) -> None:
    """All columns of ``SCENARIO``; those that are missing are null."""
    columns = [f.name for f in scenarios.sparkSession.createDataFrame([], SCENARIO).schema]
    scenarios.select(*(F.col(c) if c in scenarios.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").json(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, SCENARIO)


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """node_id and fields of an exported graph's nodes, each id once."""
    return spark.read.json(f"{path}/nodes").dropDuplicates(["node_id"])


def count_broken(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """n_rows and n_broken of JSON lines: what ``read_jsonl`` keeps and leaves out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    whole = F.from_json("value", f"{schema}, broken_ string", {"columnNameOfCorruptRecord": "broken_"})
    return lines.select(whole.alias("x")).agg(F.count_if(F.col("x.broken_").isNull()).alias("n_rows"), F.count_if(F.col("x.broken_").isNotNull()).alias("n_broken"))
