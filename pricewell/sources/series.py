"""Item series from CSV: five lines, then titles by rows or by columns, told apart by their header."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ColumnsMissing, FileEmpty, OrientationUnknown
from ..functions.periods import parse_column
from ..functions.text import normalized
from .tables import records

#: Lines above the header, its first title, and the patterns of periods and of items with a code.
HEADER_LINES, TITLE = 5, "Título"
PERIOD = r"(?U)^[12]Q \w+ \d{4}$"
CODE = r"\b\d{3}\b\s*(.*)"
#: Items that the files of 2010 spell in another way, and the prefix of a hierarchical file's first titles.
ALIASES = {
    "vestidos faldas y pantalones para niña": "vestidos faldas y pantalones para niñas",
    "papel higienico y pañuelos deshechables": "papel higienico y pañuelos desechables",
}
HIERARCHY_PREFIX, SAMPLE = "quincenal ", 10


def read_series(spark: SparkSession, path: str, version: int, aliases: dict[str, str] | None = None) -> DataFrame:
    """version, generico, ord, valor (null where the file has no number). A series may lie in several files, each with its own header."""
    cell = F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))
    table = records(spark, path, HEADER_LINES).select("file", "row", F.get("cells", F.lit(0)).alias("first"), cell.alias("cells"))
    head = F.col("row") == 0
    seen = table.agg(F.count_distinct("file").alias("files"), F.count_if(head).alias("headers"), F.max(F.when(head & ~F.col("first").eqNullSafe(TITLE), F.struct("file", "first"))).alias("other")).first()
    if seen.headers < max(seen.files, 1):
        raise FileEmpty(path)
    if seen.other:
        raise ColumnsMissing(f"the first column must be {TITLE!r}, not {seen.other.first!r}")
    header = table.where(head).select("file", "cells", F.coalesce(F.exists("cells", lambda x: x.rlike(PERIOD)), F.lit(False)).alias("across"))
    body, aliases = table.where(~head), aliases or ALIASES
    kinds = {r.across for r in header.select("across").distinct().collect()}
    found = ([_across(header.where("across"), body, aliases)] if True in kinds else []) + ([_down(header.where("not across"), body, aliases, path)] if False in kinds else [])
    return reduce(DataFrame.unionByName, found).select(F.lit(version).alias("version"), "generico", "ord", F.col("cell").try_cast("double").alias("valor"))


def _across(header: DataFrame, body: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """generico, ord, cell of files with a title a row; a short row lacks its last cells."""
    names = header.select("file", F.posexplode("cells").alias("pos", "name")).where(F.col("name").rlike(PERIOD))
    spans = names.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", parse_column(F.col("name"), "Q").alias("ord")))).alias("spans"))
    rows = body.join(F.broadcast(spans), "file").where("first is not null")  # one line a file
    items = named(rows.select("file", F.col("row").alias("place"), F.col("first").alias("titulo"), "cells", "spans"), aliases)
    return items.select("generico", "cells", F.explode("spans").alias("s")).select("generico", "s.ord", F.get("cells", F.col("s.pos")).alias("cell"))


def _down(header: DataFrame, body: DataFrame, aliases: dict[str, str], path: str) -> DataFrame:
    """generico, ord, cell of files with a title a column."""
    rows = body.where(F.col("first").rlike(PERIOD)).join(F.broadcast(header.select("file", F.size("cells").alias("n"))), "file")  # a number a file
    if header.join(rows.select("file").distinct(), "file", "left_anti").limit(1).count():
        raise OrientationUnknown(path)
    items = named(header.select("file", F.posexplode("cells").alias("place", "titulo")).where("titulo is not null"), aliases)
    padded = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.greatest(F.col("n") - F.size("cells"), F.lit(0))))
    long = rows.select("file", parse_column(F.col("first"), "Q").alias("ord"), F.posexplode(padded).alias("place", "cell"))
    return long.join(items, ["file", "place"]).select("generico", "ord", "cell")


def write_series(lines: DataFrame, header: str, path: str) -> None:
    """A folder with text files of lines (value), one a task, each with five lines and the header above its own."""
    top = [*["x"] * HEADER_LINES, header]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": top})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines.select("value").mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def named(titles: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Adds generico to the rows (file, place, titulo) that are items: those with a code of three digits, or the leaves of a hierarchy."""
    coded = titles.where(F.col("titulo").rlike(CODE))
    head = [r.titulo for r in coded.select("file", "place", "titulo").orderBy("file", "place").limit(SAMPLE).collect()]
    if head and not all(t.lower().startswith(HIERARCHY_PREFIX) for t in head):
        return coded.withColumn("generico", normalized(F.regexp_extract("titulo", CODE, 1)))
    return titles.join(leaves(titles.select("file", "place", "titulo"), aliases).select("file", "place", "generico"), ["file", "place"])


def leaves(titles: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Titles that no other extends by a comma; an item's name is what follows its longest parent. Titles without a parent are dropped."""
    parts = titles.withColumn("parts", F.split("titulo", ", "))
    upto = parts.where(F.size("parts") > 1).select("file", "place", "titulo", F.explode(F.expr("transform(sequence(1, size(parts) - 1), n -> named_struct('n', n, 'prefix', array_join(slice(parts, 1, n), ', ')))")).alias("p"))
    prefixes = upto.select("file", "place", "titulo", "p.n", "p.prefix")
    known = prefixes.join(titles.select(F.col("titulo").alias("prefix")).distinct(), "prefix")
    parents = known.select(F.col("prefix").alias("titulo")).distinct()
    longest = known.withColumn("r", F.row_number().over(W.partitionBy("file", "place", "titulo").orderBy(F.desc("n")))).where("r = 1")
    own = longest.join(parents, "titulo", "left_anti").select("file", "place", "titulo", F.expr("substring(titulo, length(prefix) + 3)").alias("name"))
    name = normalized(F.col("name"))
    if aliases:
        name = F.coalesce(F.try_element_at(F.create_map(*(normalized(F.lit(x)) for kv in aliases.items() for x in kv)), name), name)
    return own.select("file", "place", "titulo", name.alias("generico"))
