"""Files into tables: delimited listings of unknown dialect, text lists, tables in running text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions.numbers import number_cl
from pricelens.operators.dedup import file_timestamp, latest_files

ENCODINGS = ["utf-8", "windows-1252"]
SEPARATORS = [",", ";", "\t"]
_WESTERN = bytes(b for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")
_C1 = "".join(chr(b) for b in range(128, 160) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def sniff(sample: bytes, separators: Iterable[str] = SEPARATORS) -> tuple[str, str]:
    """(encoding, separator) of a file by its first bytes: the first encoding that reads them and the first separator
    that parts the header."""
    for encoding in ENCODINGS:
        try:
            text = sample.decode("utf-8-sig" if encoding == "utf-8" else encoding)
        except UnicodeDecodeError as e:
            if e.start < len(sample) - 4:  # a character cut off at the sample's end is no sign
                continue
            text = sample[: e.start].decode("utf-8-sig" if encoding == "utf-8" else encoding)
        header = text.splitlines()[0] if text.splitlines() else ""
        return encoding, next((s for s in separators if s in header), ",")
    return "ISO-8859-1", ","


def read_delimited(spark: SparkSession, path: str, separators: Iterable[str] = SEPARATORS) -> DataFrame:
    """A delimited file with header, every column as text; dialect found out from its first 64 KB, UTF-8 checked on all of it.

    Quoted fields may hold line ends. An empty file has no columns and no rows.
    """
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("c"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid")).limit(1).collect()
    if not head or not bytes(head[0]["c"]).strip():
        return spark.createDataFrame([], "")
    encoding, separator = sniff(bytes(head[0]["c"]), separators)
    if encoding == "utf-8" and not head[0]["valid"]:  # its first accented letter comes late
        encoding = "windows-1252"
    western = encoding == "windows-1252"  # Spark reads its bytes as ISO-8859-1; they differ in 0x80 to 0x9F
    table = spark.read.csv(path, header=True, sep=separator, encoding="ISO-8859-1" if western else encoding, inferSchema=False, multiLine=True, escape='"', mode="PERMISSIVE")
    return table.select(*[F.translate(F.col(f"`{c}`"), _C1, _WESTERN).alias(c) for c in table.columns]) if western else table


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, folder, file, modified, bytes) of the files of a pattern, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.substring_index("path", "/", -1).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def consolidate_market(spark: SparkSession, glob: str, market: str, by_time: bool = True) -> DataFrame:
    """The newest file of each category folder, all columns as text, with where each row comes from."""
    files = list_files(spark, glob)
    newest = latest_files(files, "folder", "path", "modified" if by_time else None).collect()
    parts = []
    for row in newest:  # one per category
        part = read_delimited(spark, row["path"])
        name = row["path"].rsplit("/", 1)[-1]
        parts.append(part.withColumns({"categoria": F.lit(row["folder"]), "archivo": F.lit(name), "ruta_archivo": F.lit(row["path"]), "supermarket": F.lit(market)}))
    if not parts:
        return spark.createDataFrame([], "categoria string, archivo string, ruta_archivo string, supermarket string, timestamp_archivo timestamp")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table.withColumn("timestamp_archivo", file_timestamp(F.col("archivo")))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(item) of every line of a text file that is neither blank nor a comment; a list without items is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("item"))
    items = lines.where((F.col("item") != "") & ~F.startswith(F.col("item"), F.lit("#")))
    if items.isEmpty():
        raise ValueError(f"{path} lists nothing")
    return items


ROW = re.compile(r"^(?P<name>.+?)\s+(?P<unit>G|CC|UN)\s+(?P<qty>[\d.,]+)\s+(?P<cal>[\d.,]+)\s+(?P<value>[\d.,]+)$")


def unwrap(lines: Iterable[str], noise: Iterable[str] = ()) -> Iterator[str]:
    """Table rows out of lines that may be wrapped: lines are joined until they make a row; noise is passed over."""
    noise = [n.lower() for n in noise]
    waiting = ""
    for line in lines:
        line = " ".join(line.split())
        if not line or any(n in line.lower() for n in noise):
            continue
        waiting = f"{waiting} {line}".strip()
        if ROW.match(waiting):
            yield waiting
            waiting = ""


def table_rows(texts: DataFrame, key: str, text: str, noise: list[str] | None = None) -> DataFrame:
    """(key, row_no, row) of the table rows in each text; a text is read where it lies."""
    key_type = texts.schema[key].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, row) for k, t in zip(b["k"], b["t"], strict=True) for i, row in enumerate(unwrap(t.split("\n"), noise or []), 1)]
            yield pd.DataFrame(rows, columns=[key, "row_no", "row"])

    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(read, f"`{key}` {key_type}, row_no int, row string")


def parse_rows(rows: DataFrame, row: str = "row") -> DataFrame:
    """The typed columns of table rows; a row of another shape has nulls."""
    pattern = ROW.pattern.replace("?P<", "?<")

    def group(i: int):
        return F.nullif(F.regexp_extract(row, pattern, i), F.lit(""))

    return rows.withColumns({"alimento": group(1), "unidad": group(2), "cantidad_dia": number_cl(group(3)), "calorias_dia": number_cl(group(4)), "valor_mensual": number_cl(group(5))})


def card_prices(text):
    """struct(price, list_price): least and greatest amount in the text of a product card."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"\$\s*(\d[\d.]*)"), 1), lambda a: F.replace(a, F.lit("."), F.lit("")).try_cast("bigint"))
    return F.struct(F.array_min(amounts).alias("price"), F.array_max(amounts).alias("list_price"))
