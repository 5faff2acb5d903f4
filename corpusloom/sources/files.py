"""Sources and sinks of records in files: CSV, JSON, lines, text, XML, archives; wrappers and exports."""

from __future__ import annotations

import fnmatch
import gzip
import io
import json
import os
import tarfile
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from corpusloom.session import spread

MISSING = "n/a"


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Rows by header; every value is a string."""
    return spark.read.option("header", True).option("sep", separator).option("multiLine", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """The elements of a JSON array, or one object a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.option("wholetext", whole).text(path)


def read_xml(spark: SparkSession, path: str, row: str, schema: str | None = None) -> DataFrame:
    """One record for each element of a name; attributes begin with an underscore."""
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema else reader).load(path)


def xml_fields(df: DataFrame, column: str, **paths: str) -> DataFrame:
    """Fields of XML documents by path: the first text of a path, or all of them for a path that ends in ``/text()``.

    Namespace prefixes are taken off first, so that paths need none; a document that is no XML ends the job.
    """
    bare = F.regexp_replace(F.regexp_replace(column, "\\sxmlns(?::\\w+)?=\"[^\"]*\"", ""), "(</?)\\w+:", "$1")
    fields = [(F.xpath(bare, F.lit(p)) if p.endswith("/text()") else F.xpath_string(bare, F.lit(p))).alias(n) for n, p in paths.items()]
    return df.select(*[c for c in df.columns if c != column], *fields)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def wrap(df: DataFrame, id_path: str = "id", value_path: str = "value", slim: bool = True) -> DataFrame:
    """Records in the id/value shape from any fields; an empty value becomes the sign for a missing one."""
    value = F.col(value_path)
    if dict(df.select(value.alias("v")).dtypes)["v"] == "string":
        value = F.when(value.isNull() | (F.trim(value) == ""), MISSING).otherwise(value)
    out = df.select(F.col(id_path).cast("string").alias("id"), value.alias("value"), *([] if slim else [F.struct(*df.columns).alias("rest")]))
    return out if slim else out.select("id", "value", *[F.col(f"rest.{c}") for c in df.columns if c not in ("id", "value")])


def flatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested fields as columns named by their paths; arrays and maps as JSON."""

    def walk(schema: T.StructType, at: list[str]) -> Iterator[Column]:
        for f in schema:
            path = [*at, f.name]
            col = F.col(".".join(f"`{p}`" for p in path))
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                col = F.to_json(col) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else col
                yield col.alias(separator.join(path))

    return df.select(*walk(df.schema, []))


def unflatten(df: DataFrame, separator: str = "/") -> DataFrame:
    """The inverse of flatten for plain fields: columns of one first part become a struct."""
    tops: dict[str, list[str]] = {}
    for c in df.columns:
        tops.setdefault(c.split(separator, 1)[0], []).append(c)
    cols = []
    for top, names in tops.items():
        inner = [(n.split(separator, 1)[1], n) for n in names if separator in n]
        cols.append(F.struct(*[F.col(f"`{n}`").alias(x) for x, n in inner]).alias(top) if inner else F.col(f"`{top}`"))
    return df.select(*cols)


def csv_cells(df: DataFrame) -> DataFrame:
    """Objects and arrays in cells as JSON, all else as it is."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, separator: str = ",", strict: bool = True, header: bool = True) -> None:
    csv_cells(df).write.mode("overwrite").option("sep", separator).option("header", header).option("quoteAll", strict).option("escape", '"').csv(path)


def lines_csv(df: DataFrame, separator: str = "/") -> DataFrame:
    """A row for each element of the value array, its fields beside the id."""
    rows = df.select("id", F.explode("value").alias("v"))
    return flatten(rows.select("id", "v.*") if rows.schema["v"].dataType.typeName() == "struct" else rows.withColumnRenamed("v", "value"), separator)


def page_lines(df: DataFrame) -> DataFrame:
    """Tables of pages as lines: ``Page: n`` and then a line of quoted cells for each row. ``df``: page, json array of maps."""
    cells = F.transform("json", lambda m: F.array_join(F.transform(F.map_values(m), lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ","))
    return df.select("page", F.explode(F.concat(F.array(F.concat(F.lit("Page: "), F.col("page").cast("string"))), cells)).alias("line"))


def gexf(nodes: list[dict], edges: list[dict]) -> str:
    """A small graph as GEXF text. Graphs too large for one file stay tables of nodes and edges."""
    out = io.StringIO()
    out.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>')
    for n in nodes:
        out.write(f"<node id={quoteattr(str(n['id']))} label={quoteattr(str(n.get('label', n['id'])))}>")
        if "size" in n:
            out.write(f"<size value={quoteattr(str(n['size']))}/>")
        out.write("</node>")
    out.write("</nodes><edges>")
    for k, e in enumerate(edges):
        out.write(f"<edge id=\"{k}\" source={quoteattr(str(e['source']))} target={quoteattr(str(e['target']))} weight={quoteattr(str(e.get('weight', 1)))}/>")
    out.write("</edges></graph></gexf>\n")
    return out.getvalue()


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.globs = options["path"], _braces(options.get("glob", "*"))

    def partitions(self):
        if os.path.isdir(self.path):
            return [_Archive(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if ".tar" in f or f.endswith(".tgz")]
        return [_Archive(self.path)]

    def read(self, partition):
        with tarfile.open(partition.path, "r:*") as tar:
            for m in tar:
                if m.isfile() and any(fnmatch.fnmatch(m.name, g) for g in self.globs):
                    yield (os.path.basename(partition.path), m.name, tar.extractfile(m).read())


def _braces(glob: str) -> list[str]:
    """Globs without braces for one with them."""
    if "{" not in glob:
        return [glob]
    head, _, rest = glob.partition("{")
    inner, _, tail = rest.partition("}")
    return [g for x in inner.split(",") for g in _braces(head + x + tail)]


class _Written(WriterCommitMessage):
    def __init__(self, path: str, count: int):
        self.path, self.count = path, count


class _CorpusWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.ext, self.schema = options["path"], options.get("extension", "json"), schema

    def write(self, rows):
        from pyspark import TaskContext

        at = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        target, count = os.path.join(self.path, f"part-{at.partitionId():05d}-{at.taskAttemptId()}.tar.gz"), 0
        with tarfile.open(target, "w:gz") as tar:
            for r in rows:
                data = json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str).encode("utf-8")
                info = tarfile.TarInfo(f"data/f{at.partitionId():05d}-{count:07d}.{self.ext}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
                count += 1
        return _Written(target, count)

    def commit(self, messages):
        with open(os.path.join(self.path, "manifest.json"), "w") as f:
            json.dump({"count": sum(m.count for m in messages if m), "parts": sorted(os.path.basename(m.path) for m in messages if m)}, f)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class CorpusSource(DataSource):
    """Archives of records: reading gives (archive, name, content), one archive a task; writing gives an archive for each
    partition and a manifest once all are there."""

    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return "archive string, name string, content binary"

    def reader(self, schema):
        return _CorpusReader(dict(self.options))

    def writer(self, schema, overwrite):
        return _CorpusWriter(dict(self.options), schema)


def read_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    spark.dataSource.register(CorpusSource)
    return spark.read.format("corpus").option("path", path).option("glob", glob).load()


def write_corpus(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(CorpusSource)
    df.write.format("corpus").option("path", path).mode("append").save()


def xml_text(c: Column, row: str = "record") -> Column:
    """A struct as XML text, its fields as elements."""
    return F.to_xml(c, {"rowTag": row})


def json_array(df: DataFrame, indent: bool = False) -> Column:
    """All records of a group as the text of a JSON array, for answers of bounded size."""
    rows = F.collect_list(F.to_json(F.struct(*df.columns), {"pretty": str(indent).lower()}))
    return F.concat(F.lit("["), F.array_join(rows, ",\n" if indent else ","), F.lit("]"))


def save(df: DataFrame, path: str, append: bool = False, compress: bool = False) -> None:
    """Records as lines of JSON under a path, added to what is there or in its place."""
    df.write.mode("append" if append else "overwrite").option("compression", "gzip" if compress else "none").json(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_json(spark, path, schema, lines=True)


def merge_files(df: DataFrame) -> DataFrame:
    """(path, content): the pieces of a file, named with a number behind a hyphen, put together in their order."""
    piece = F.regexp_extract("path", "-(\\d+)[^/]*$", 1).try_cast("int")
    name = F.regexp_replace("path", "-\\d+([^/]*)$", "$1")
    parts = df.select(name.alias("path"), F.struct(F.coalesce(piece, F.lit(0)).alias("n"), F.hex("content").alias("c")).alias("p"))
    return parts.groupBy("path").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["c"]), "")).alias("content"))


def wrap_documents(docs: DataFrame, schema: str, id_path: str = "ark.0", value_path: str = "abstract") -> DataFrame:
    """Records in the id/value shape from the JSON files of an archive (path, content); a number in a path is a position."""
    from corpusloom.functions.arrays import get_path

    r = docs.select(F.from_json(F.col("content").cast("string"), schema).alias("r"))
    value = get_path(F.col("r"), value_path)
    return r.select(get_path(F.col("r"), id_path).cast("string").alias("id"), F.when(value.isNull() | (F.trim(value) == ""), MISSING).otherwise(value).alias("value"))


def wrap_query(manifest: str, docs: DataFrame) -> DataFrame:
    """The query of a manifest (JSON text with ``query.q``) as the first record, with the records of its documents."""
    spark = docs.sparkSession
    head = spark.range(1).select(F.lit("query").alias("id"), F.coalesce(F.get_json_object(F.lit(manifest), "$.query.q"), F.lit(MISSING)).alias("value"))
    return head.unionByName(docs.select("id", "value"))


def wrap_text(spark: SparkSession, path: str, name: str = "txt") -> DataFrame:
    """One record for a whole text: its name and its content."""
    return read_text(spark, path, whole=True).select(F.lit(name).alias("id"), F.when(F.trim("value") == "", MISSING).otherwise(F.col("value")).alias("value"))


def decompress(c: Column) -> Column:
    """The content of gzipped bytes as text."""
    return F.udf(lambda b: None if b is None else gzip.decompress(bytes(b)).decode("utf-8"), "string", useArrow=True)(c)


def pages_of(fetch, keys: list[str], size: int) -> Iterator[dict]:
    """Results of a paged search: ``fetch(key, page)`` until a page is short; for connectors with an outside service."""
    for key in keys:
        page = 0
        while True:
            got = fetch(key, page)
            yield from got
            if len(got) < size:
                break
            page += 1


def read_pages(keys: DataFrame, key: str, fetch, size: int, schema: str, tries: int = 3) -> DataFrame:
    """The records of paged searches, one search for each key, spread over the tasks. ``fetch(key, page)`` gives a list of
    dicts; a failing call is tried again."""
    from corpusloom.streaming.jobs import with_retries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(pages_of(lambda k, page: with_retries(lambda: fetch(k, page), tries), b[key].tolist(), size))
            yield pd.DataFrame([[r.get(c) for c in columns] for r in rows], columns=columns)

    columns = [c.split()[0].split(":")[0] for c in schema.split(",")]
    return spread(keys.select(key).distinct()).mapInPandas(run, schema)


def ask_in_batches(df: DataFrame, key: str, ask, size: int, schema: str, tries: int = 3) -> DataFrame:
    """(key, the answer's fields) for the distinct keys, ``size`` of them a call. ``ask(keys)`` gives a dict of key to a dict;
    of what it does not know there is a row with nulls."""
    from corpusloom.operators.joins import batched
    from corpusloom.streaming.jobs import with_retries

    columns = [c.split()[0].split(":")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batched((k for b in batches for k in b[key].tolist()), size):
            known = with_retries(lambda: ask(part), tries)  # noqa: B023
            yield pd.DataFrame([[k, *((known.get(k) or {}).get(c) for c in columns)] for k in part], columns=[key, *columns])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key).filter(F.col(key).isNotNull()).distinct()).mapInPandas(run, f"{key} {kind}, {schema}")
