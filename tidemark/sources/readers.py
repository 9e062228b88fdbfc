"""Readers: delimited, fixed-width, zipped, spreadsheet and paged JSON inputs, and uploads' checks.

Cells are read as text and typed later (operators.profile). Only file names, sizes and a first kilobyte are looked at on the
driver; contents are read by tasks.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MOST_UPLOAD_BYTES = 50 * 1024 * 1024
# Upload kinds by extension.
MIME = {"csv": ("text/csv", "application/csv", "text/plain"), "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), "xls": ("application/vnd.ms-excel",)}
# Words in file names that tell their kind.
KINDS = {"census": ("census", "registration"), "safety": ("sms", "safety"), "inspection": ("inspection",)}


def normalized_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower case, spaces as _."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def clean_names(df: DataFrame) -> DataFrame:
    """Names in lower case, runs of space - _ . as _, other signs dropped, no outer _, repeats numbered _1, _2 ..."""
    import re

    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = re.sub(r"\W", "", re.sub(r"[\s\-_.]+", "_", c.lower())).strip("_")
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return df.toDF(*out)


def sniffed(spark: SparkSession, path: str) -> str:
    """The delimiter that a first kilobyte of text suggests, else a comma."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1024).cast("string").alias("head")).first()
    try:
        return csv.Sniffer().sniff(head["head"] if head else "", delimiters=",;|\t").delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, trim: bool = True) -> DataFrame:
    """A delimited file or folder with a header; all text, empty cells null, names normalised."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
    return normalized_names(reader.csv(path, sep=sep or sniffed(spark, path)))


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Fields (name, start from 0, length) of a text's lines; short lines give '', blank lines go."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(*[F.trim(F.substring("value", start + 1, n)).alias(name) for name, start, n in fields])


def kind_of(path: str) -> str:
    """census, safety or inspection by the file's name."""
    name = path.rsplit("/", 1)[-1].lower()
    for kind, words in KINDS.items():
        if any(w in name for w in words):
            return kind
    raise ValueError(f"no reader for {path}")


def upload_problems(name: str, size: int, mime: str) -> list[str]:
    """What speaks against an upload."""
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    out = []
    if size > MOST_UPLOAD_BYTES:
        out.append("larger than 50 MB")
    if extension not in MIME:
        out.append("unknown extension")
    elif mime.split(";")[0].strip().lower() not in MIME[extension]:
        out.append("content type and extension differ")
    return out


def files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path, bytes and modified of the files in a folder, without their contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return found.where(F.col("bytes") <= most_bytes) if most_bytes else found


def latest_file(spark: SparkSession, path: str, glob: str = "*") -> str | None:
    row = files(spark, path, glob).orderBy(F.desc("modified"), F.desc("path")).first()
    return row["path"] if row else None


def read_folder(spark: SparkSession, path: str, most_bytes: int = MOST_UPLOAD_BYTES) -> DataFrame:
    """All CSV files of a folder up to a size, with their file name."""
    names = [r["path"] for r in files(spark, path, "*.csv", most_bytes).select("path").collect()]  # file names alone
    return spark.read.option("header", True).csv(names).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def quick_shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def unzipped(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".csv", ".txt")) -> DataFrame:
    """archive, member, line (number from 1) and value of the text members of ZIP files; a task per archive."""

    def run(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in (m for m in z.namelist() if m.lower().endswith(suffixes)):
                        with io.TextIOWrapper(z.open(member), "utf-8", errors="replace", newline=None) as text:
                            rows = []
                            for i, line in enumerate(text, 1):
                                rows.append((name, member, i, line.rstrip("\n")))
                                if len(rows) == 10_000:
                                    yield pa.RecordBatch.from_pylist([dict(zip(("archive", "member", "line", "value"), r, strict=True)) for r in rows])
                                    rows = []
                            if rows:
                                yield pa.RecordBatch.from_pylist([dict(zip(("archive", "member", "line", "value"), r, strict=True)) for r in rows])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line bigint, value string")


def read_sheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """The cells of workbooks' sheets as text: file, row, col, value. A workbook is a ZIP of XML, read in a task."""

    def run(batches: Iterator) -> Iterator:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pyarrow as pa

        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
                    rows = []
                    for c in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{{{ns['m']}}}c"):
                        letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        col = 0
                        for ch in letters:
                            col = col * 26 + ord(ch) - 64
                        v = c.find("m:v", ns)
                        text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                        rows.append({"file": name, "row": int(row), "col": col, "value": (text or "").strip()})
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("row", pa.int64()), ("col", pa.int64()), ("value", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row bigint, col bigint, value string")


def sheet_table(cells: DataFrame) -> DataFrame:
    """The table of one workbook's cells: row 1 names the columns, cells beyond them go, '' is null."""
    header = {r["col"]: r["value"] for r in cells.where("row = 1").collect()}  # one row of names
    if not header or not cells.where("row > 1").take(1):
        raise ValueError("a header and a row of data are needed")
    wide = cells.where("row > 1").groupBy("row").pivot("col", sorted(header)).agg(F.first("value"))
    return wide.select("row", *[F.nullif(F.col(str(c)), F.lit("")).alias(header[c]) for c in sorted(header)])


class PagedJson(DataSource):
    """Records of a paged JSON interface, a partition per page. Options: url (with {page} or {offset}), pages, limit, path (dotted, to
    the list of records), token (bearer). Each row is a record's JSON text and its page; parse with from_json.

    A page that fails is retried by Spark like any task. file: URLs serve for tests.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedJsonReader(dict(self.options))


class PagedJsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import json
        from urllib.request import Request, urlopen

        page, limit = partition.value, int(self.options.get("limit", "100"))
        url = self.options["url"].replace("{page}", str(page)).replace("{offset}", str((page - 1) * limit)).replace("{limit}", str(limit))
        headers = {"Authorization": f"Bearer {self.options['token']}"} if "token" in self.options else {}
        with urlopen(Request(url, headers=headers), timeout=30) as answer:
            data = json.load(answer)
        for step in filter(None, self.options.get("path", "").split(".")):
            data = data[int(step)] if isinstance(data, list) else data.get(step, [])
        for record in data if isinstance(data, list) else [data]:
            yield page, json.dumps(record)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)


def object_events(records: DataFrame, column: str = "record") -> DataFrame:
    """entity_id (`id`, else a hash of the object), observed_at (`timestamp`, else null) and payload of JSON objects."""
    get = lambda k: F.get_json_object(column, f"$.{k}")
    return records.select(F.coalesce(get("id"), F.sha2(column, 256)).alias("entity_id"), F.try_to_timestamp(get("timestamp")).alias("observed_at"), F.col(column).alias("payload"))


def wide_events(df: DataFrame, entity: str, columns: Sequence[str], observed_at) -> DataFrame:
    """entity_id, field_key, raw and observed_at of every cell."""
    long = df.select(F.col(entity).cast("string").alias("entity_id"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["entity_id"], list(columns), "field_key", "raw")
    return long.withColumn("observed_at", F.lit(observed_at).cast("timestamp"))


def synthetic_matrix(spark: SparkSession, rows: int = 1000, seed: int = 42) -> DataFrame:
    """entity_id and four related variables, by seeded generators: violations follow the inspection count."""
    base = spark.range(rows).select(F.format_string("entity_%d", "id").alias("entity_id"), F.floor(F.rand(seed) * 10).cast("double").alias("inspection_count"), F.randn(seed + 1).alias("__e"), F.floor(F.rand(seed + 2) * 4).cast("double").alias("region"))
    return base.select("entity_id", "inspection_count", (F.lit(50.0) + 4 * F.col("inspection_count") + 8 * F.col("__e")).alias("severity_score"), "region", (F.col("inspection_count") + F.col("__e") > 5).cast("double").alias("has_violation"))


# --- databases


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database's table (or a query in brackets with a name). With a whole-number or time column it is read in so many ranges of it at once,
    whose ends the database tells; rows without a value go to the first. Filters and column lists are the database's work."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if column is None:
        return reader.option("dbtable", table).load()
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    ends = reader.option("dbtable", f"(SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}) ends").load().first()
    reader = reader.option("dbtable", table)
    if ends[0] is None or ends[0] == ends[1]:
        return reader.load()
    return reader.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1]), numPartitions=str(partitions)).load()
