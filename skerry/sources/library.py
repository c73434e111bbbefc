"""Bibliographic libraries in normalised tables (SRC-9..SRC-12, JOIN-1..JOIN-8, JOIN-10, JOIN-13, SP-7, SP-22).

Every child table is aggregated by its item before it is joined, so the plan is a set of
joins on itemID, whatever the number of items.
"""

from __future__ import annotations

from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from ..functions import text as T

#: The tables read and their columns.
TABLES = {
    "items": "itemID long, itemTypeID int, dateAdded string, dateModified string, key string",
    "deletedItems": "itemID long",
    "itemData": "itemID long, fieldID int, valueID long",
    "itemDataValues": "valueID long, value string",
    "fields": "fieldID int, fieldName string",
    "itemCreators": "itemID long, creatorID long, orderIndex int",
    "creators": "creatorID long, firstName string, lastName string",
    "itemTags": "itemID long, tagID long",
    "tags": "tagID long, name string",
    "collectionItems": "collectionID long, itemID long",
    "collections": "collectionID long, collectionName string",
    "itemAttachments": "itemID long, parentItemID long, path string, contentType string",
    "itemNotes": "itemID long, parentItemID long, note string",
}


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


def database_in(directory: str | None) -> str | None:
    """The first SQLite file of a library's folder, if there is one."""
    found = sorted(Path(directory).expanduser().glob("*.sqlite")) if directory else []
    return str(found[0]) if found else None


MAX_ROWID = 2**63 - 1
#: Rows of a partition, rows handed on at a time, and values of an IN list that is sent to the database.
PARTITION_ROWS, FETCH_ROWS, MAX_IN = 100_000, 10_000, 500
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _condition(f, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL with its values, or None where the database could judge it otherwise than Spark."""
    column = f.attribute[0] if len(f.attribute) == 1 else None
    kind = kinds.get(column)
    if kind is None:
        return None
    name = f'"{column}"'
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    fits = (lambda v: type(v) is str) if kind == "string" else (lambda v: type(v) is int)
    # Strings by their bytes, as Spark does, whatever order the column was declared with.
    compared = f"{name} COLLATE BINARY" if kind == "string" else name
    if type(f) in _COMPARED and fits(f.value):
        return f"{compared} {_COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and 0 < len(f.value) <= MAX_IN and all(map(fits, f.value)):
        return f"{compared} IN ({', '.join('?' * len(f.value))})", list(f.value)
    return None


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        """Filters that the database judges first; Spark judges all of them again, as SQLite's columns may hold any type."""
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        for f in filters:
            if hasattr(f, "attribute") and (found := _condition(f, kinds)):
                self.where.append(found[0])
                self.values += found[1]
            yield f

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"{Path(self.options['path']).absolute().as_uri()}?mode=ro", uri=True, timeout=float(self.options.get("timeout", "5")))

    def _retried(self, run):
        import sqlite3
        import time

        for attempt in range(int(self.options.get("retries", "3")) + 1):
            try:
                return run()
            except sqlite3.OperationalError as e:
                if "locked" not in str(e) or attempt == int(self.options.get("retries", "3")):
                    raise
                time.sleep(0.2 * 2**attempt)

    def _statement(self, columns: str, *more: str) -> str:
        conditions = [*self.where, *more]
        return f'SELECT {columns} FROM "{self.options["table"]}"' + (" WHERE " + " AND ".join(conditions) if conditions else "")

    def partitions(self):
        """Ranges of rowid that hold as many rows that pass the filters each, whatever gaps the ids have."""
        size = max(1, int(self.options.get("rows", PARTITION_ROWS)))
        numbered = self._statement("rowid AS id, row_number() OVER (ORDER BY rowid) - 1 AS place")

        def bounds():
            with closing(self._connect()) as c:
                return [r[0] for r in c.execute(f"SELECT id FROM ({numbered}) WHERE place % ? = 0 ORDER BY id", (*self.values, size))]

        starts = self._retried(bounds)
        ends = [s - 1 for s in starts[1:]] + [MAX_ROWID]
        return [_Range(a, b) for a, b in zip(starts, ends, strict=True)] if starts else [_Range(0, -1)]

    def read(self, partition):
        columns = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        query = self._statement(columns, "rowid BETWEEN ? AND ?")
        with closing(self._connect()) as c:
            # The first rows take the lock that the statement then holds to its end, so only they can find the file locked.
            def first():
                cursor = c.execute(query, (*self.values, partition.low, partition.high))
                return cursor, cursor.fetchmany(FETCH_ROWS)

            cursor, rows = self._retried(first)
            while rows:
                yield from rows
                rows = cursor.fetchmany(FETCH_ROWS)


class SqliteSource(DataSource):
    """Read-only SQLite tables: options path, table, rows (of a partition), timeout, retries.

    Filters that compare a column with values are part of the statement sent; a schema given to the reader names the columns that are read.
    """

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        return TABLES[self.options["table"]]

    def reader(self, schema):
        return _Reader(schema, self.options)


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, rows: int = PARTITION_ROWS) -> DataFrame:
    """One table of a library, or some columns of it, with about ``rows`` rows a partition."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    kinds = dict(c.split(" ") for c in TABLES[table].split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("sqlite_table").schema(schema).options(path=str(Path(path).expanduser()), table=table, rows=rows).load()


def read_sqlite(spark: SparkSession, path: str, rows: int = PARTITION_ROWS) -> dict[str, DataFrame] | None:
    """The library's tables, or None where there is no file."""
    if not Path(path).expanduser().is_file():
        return None
    return {t: read_table(spark, path, t, rows=rows) for t in TABLES}


def live_items(t: dict[str, DataFrame]) -> DataFrame:
    """Items that aren't deleted (SRC-10, JOIN-7)."""
    return t["items"].join(t["deletedItems"], "itemID", "left_anti")


def metadata(t: dict[str, DataFrame]) -> DataFrame:
    """itemID, metadata map; of a field given twice the value with the largest id counts (JOIN-1)."""
    rows = t["itemData"].join(t["itemDataValues"], "valueID").join(t["fields"], "fieldID")
    last = rows.groupBy("itemID", "fieldName").agg(F.max_by("value", "valueID").alias("value"))
    return last.groupBy("itemID").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fieldName", "value")))).alias("metadata"))


def creators(t: dict[str, DataFrame]) -> DataFrame:
    """itemID, names in their order (JOIN-2, SRT-1); a missing part leaves no trace (Q-17)."""
    rows = t["itemCreators"].join(t["creators"], "creatorID")
    name = F.trim(F.concat_ws(" ", "firstName", "lastName"))
    return rows.groupBy("itemID").agg(F.transform(F.array_sort(F.collect_list(F.struct("orderIndex", "creatorID", name.alias("name")))), lambda x: x["name"]).alias("creators"))


def tags(t: dict[str, DataFrame]) -> DataFrame:
    return t["itemTags"].join(t["tags"], "tagID").groupBy("itemID").agg(F.array_sort(F.collect_list("name")).alias("tags"))


def collections(t: dict[str, DataFrame]) -> DataFrame:
    return t["collectionItems"].join(t["collections"], "collectionID").groupBy("itemID").agg(F.array_sort(F.collect_list("collectionName")).alias("collections"))


def attachments(t: dict[str, DataFrame], storage: str = "storage", parent_key: bool = False) -> DataFrame:
    """itemID of the parent, stored files under the attachment's own key (JOIN-5, FIL-8, FIL-9, Q-5); deleted ones don't count (Q-16)."""
    rows = t["itemAttachments"].where(F.col("path").isNotNull() & F.startswith("path", F.lit("storage:"))).join(t["deletedItems"], "itemID", "left_anti")
    keys = t["items"].select(F.col("itemID").alias("_k"), "key")
    rows = rows.join(keys, (F.col("parentItemID") if parent_key else rows["itemID"]) == F.col("_k"))
    path = F.concat_ws("/", F.lit(storage), "key", F.expr("substring(path, 9)"))
    return rows.groupBy(F.col("parentItemID").alias("itemID")).agg(F.array_sort(F.collect_list(F.struct(path.alias("path"), "contentType"))).alias("attachments"))


def notes(t: dict[str, DataFrame]) -> DataFrame:
    rows = t["itemNotes"].join(t["deletedItems"], "itemID", "left_anti")
    return rows.groupBy(F.col("parentItemID").alias("itemID")).agg(F.transform(F.array_sort(F.collect_list(F.struct("itemID", "note"))), lambda x: x["note"]).alias("notes"))


def items(t: dict[str, DataFrame], storage: str = "storage") -> DataFrame:
    """Live items with all that belongs to them; nothing is an empty list (JOIN-8)."""
    out = live_items(t).select("itemID", T.item_uri(F.col("itemID")).alias("doc_id"), F.col("itemTypeID").alias("item_type_id"), F.col("dateAdded").alias("date_added"), F.col("dateModified").alias("date_modified"))
    for part in (metadata(t), creators(t), tags(t), collections(t), attachments(t, storage), notes(t)):
        out = out.join(part, "itemID", "left")
    empty = F.array().cast("array<string>")
    for c in ("creators", "tags", "collections", "notes"):
        out = out.withColumn(c, F.coalesce(c, empty))
    out = out.withColumn("attachments", F.coalesce("attachments", F.array().cast("array<struct<path:string,contentType:string>>")))
    out = out.withColumn("metadata", F.coalesce("metadata", F.map_from_arrays(empty, empty)))
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return out.withColumn("title", get("title")).withColumn("year", T.year_of(get("date")))


def documents(found: DataFrame, file_texts: DataFrame | None = None) -> DataFrame:
    """Items as documents: their notes without markup, then their attachments' texts (path, text); blank ones go (SRC-12, JOIN-13)."""
    note_text = F.array_join(F.transform("notes", T.strip_html), "\n\n")
    out = found.withColumn("_notes", note_text)
    if file_texts is not None:
        files = found.select("doc_id", F.posexplode("attachments").alias("i", "a")).select("doc_id", "i", F.col("a.path").alias("path"))
        own = files.join(file_texts.select("path", "text"), "path").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("_files"))
        out = out.join(own, "doc_id", "left")
    else:
        out = out.withColumn("_files", F.lit(None).cast("string"))
    text = F.array_join(F.filter(F.array("_notes", "_files"), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return out.withColumn("text", text).where(~T.is_blank(F.col("text"))).select("doc_id", F.lit("library").alias("source"), F.col("doc_id").alias("path"), "title", "creators", "year", "tags", "collections", "text")


def bibtex(found: DataFrame) -> DataFrame:
    """doc_id, citekey, entry of each item (SP-7)."""
    get = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    last = F.regexp_replace(F.lower(F.coalesce(F.element_at(F.split(F.coalesce(F.get("creators", F.lit(0)), F.lit("anon")), " "), -1), F.lit("anon"))), r"[^\p{L}\p{N}]", "")
    key = F.concat(last, F.coalesce(F.col("year").cast("string"), F.lit("nd")), F.lit("_"), F.element_at(F.split("doc_id", ":"), -1))
    entry = F.format_string("@misc{%s,\n  title = {%s},\n  author = {%s},\n  year = {%s}\n}", key, get("title"), F.array_join("creators", " and "), F.coalesce(F.col("year").cast("string"), F.lit("")))
    return found.select("doc_id", key.alias("citekey"), entry.alias("entry"))
