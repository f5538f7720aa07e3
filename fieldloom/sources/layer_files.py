"""Map layers of GeoPackage files as a Spark data source.

``spark.dataSource.register(LayerFiles)``, then ``spark.read.format("layers")
.load(path)``. A layer is read in ranges of row numbers, each a partition of its
own; only the columns of the schema that is asked for are read, and equality,
range and null filters go into the file's query (with
spark.sql.python.filterPushdown.enabled). Geometries come as rings of longitude
and latitude: a file's coordinate reference system is looked up, degrees (EPSG
4326) are taken as they are, web Mercator (3857) is turned into degrees, any
other is refused.
"""

from __future__ import annotations

import math
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: Rows of a partition; rows of an Arrow batch.
RANGE_ROWS, BATCH_ROWS = 20_000, 1_000
DEGREES, MERCATOR = 4326, 3857
EARTH = 6378137.0
RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
#: Bytes of a geometry's envelope by its kind.
ENVELOPES = (0, 32, 48, 48, 64)


def _open(path: str) -> sqlite3.Connection:
    if "://" not in path:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    from pyarrow import fs as pafs

    fs, where = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(where) as f:
        data = f.read()
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layers(con: sqlite3.Connection) -> dict[str, dict]:
    """Per layer its columns with their types, geometry column, system of reference and row numbers."""
    out = {}
    rows = con.execute("SELECT c.table_name, g.column_name, s.organization, s.organization_coordsys_id FROM gpkg_contents c LEFT JOIN gpkg_geometry_columns g ON g.table_name = c.table_name LEFT JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id WHERE c.data_type IN ('features', 'attributes') ORDER BY c.table_name").fetchall()
    for table, geometry, organisation, code in rows:
        columns = {c[1]: c[2].upper() for c in con.execute(f"PRAGMA table_info({_quoted(table)})")}
        columns.pop(geometry, None)
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        out[table] = {"columns": columns, "geometry": geometry, "system": (str(organisation).upper(), code) if geometry else None, "rows": (low, high)}
    return out


def _type(declared: str) -> T.DataType:
    if "INT" in declared:
        return T.LongType()
    return T.DoubleType() if any(x in declared for x in ("REAL", "FLOA", "DOUB")) else T.StringType()


def rings_of(blob: bytes | None, system: int = DEGREES) -> list | None:
    """Rings of [longitude, latitude] of a stored polygon or point; None for none and for other kinds."""
    if not blob or blob[:2] != b"GP":
        return None
    at = 8 + ENVELOPES[(blob[3] >> 1) & 7]
    if blob[3] & 16:
        return []

    def shape(at: int) -> tuple[list | None, int]:
        order = "<" if blob[at] else ">"
        (kind,) = struct.unpack_from(order + "I", blob, at + 1)
        width = 2 + (kind // 1000 % 10 in (1, 2)) + 2 * (kind // 1000 % 10 == 3)
        kind, at = kind % 1000, at + 5

        def points(at: int, n: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{n * width}d", blob, at)
            return [_degrees(flat[i], flat[i + 1], system) for i in range(0, n * width, width)], at + 8 * n * width

        if kind == 1:
            found, at = points(at, 1)
            return [found], at
        if kind not in (3, 6):
            return None, at
        (n,) = struct.unpack_from(order + "I", blob, at)
        at, out = at + 4, []
        for _ in range(n):
            if kind == 6:
                found, at = shape(at)
                out += found or []
            else:
                (size,) = struct.unpack_from(order + "I", blob, at)
                found, at = points(at + 4, size)
                out.append(found)
        return out, at

    return shape(at)[0]


def _degrees(x: float, y: float, system: int) -> list[float]:
    if system == MERCATOR:
        return [math.degrees(x / EARTH), math.degrees(2 * math.atan(math.exp(y / EARTH)) - math.pi / 2)]
    return [x, y]


class _Range(InputPartition):
    def __init__(self, layer: str, low: int, high: int):
        super().__init__((layer, low, high))
        self.layer, self.low, self.high = layer, low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, wanted: list[str] | None, rows: int):
        self.path, self.schema, self.rows = path, schema, rows
        with _open(path) as con:
            self.layers = {k: v for k, v in _layers(con).items() if wanted is None or k in wanted}
        for name, layer in self.layers.items():
            if "geometry" in schema.names and layer["system"] and layer["system"] not in (("EPSG", DEGREES), ("EPSG", MERCATOR)):
                raise ValueError(f"layer {name} of {path} is in {layer['system']}, not in EPSG {DEGREES} or {MERCATOR}")
        self.clauses: list[tuple[str, str, list]] = []

    def partitions(self) -> list[InputPartition]:
        out = []
        for name, layer in self.layers.items():
            low, high = layer["rows"]
            if low is not None:
                out += [_Range(name, a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.layer:
            return
        layer = self.layers[partition.layer]
        own = {c.lower(): c for c in layer["columns"]}
        of = lambda name: f"CAST({_quoted(own[name.lower()])} AS {_AFFINITY[type(self.schema[name].dataType)]})" if name.lower() in own else "NULL"
        picked = []
        for name in self.schema.names:
            if name == "layer":
                picked.append("?")
            elif name == "row":
                picked.append("rowid")
            elif name == "geometry":
                picked.append(_quoted(layer["geometry"]) if layer["geometry"] else "NULL")
            else:
                picked.append(of(name))
        given = [partition.layer] * ("layer" in self.schema.names)
        where, more = ["rowid >= ?", "rowid < ?"], [partition.low, partition.high]
        for name, clause, values in self.clauses:
            where.append(clause.format(of(name)))
            more += values
        system = layer["system"][1] if layer["system"] else DEGREES
        with _open(self.path) as con:
            cursor = con.execute(f"SELECT {', '.join(picked)} FROM {_quoted(partition.layer)} WHERE {' AND '.join(where)} ORDER BY rowid", given + more)
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = dict(zip(self.schema.names, map(list, zip(*rows, strict=True)), strict=True))
                if "geometry" in columns:
                    columns["geometry"] = [rings_of(b, system) for b in columns["geometry"]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], _ARROW[type(f.dataType)]) for f in self.schema], names=self.schema.names)


class _FilteringReader(_Reader):
    """A reader for sessions that hand filters to sources in Python; others refuse a reader that asks for them."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """What a column's declared type makes sure in the file's query; the rest stays Spark's."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            kind = self.schema[name].dataType if name in self.schema.names else None
            plain = name not in ("layer", "geometry", "row") and isinstance(kind, (T.StringType, T.LongType, T.DoubleType))
            fits = lambda v, kind=kind: isinstance(v, str) if isinstance(kind, T.StringType) else isinstance(v, (int, float)) and not isinstance(v, bool)
            if name == "layer" and isinstance(f, EqualTo):
                self.layers = {k: v for k, v in self.layers.items() if k == f.value}
            elif name == "layer" and isinstance(f, In):
                self.layers = {k: v for k, v in self.layers.items() if k in f.value}
            elif plain and type(f) in signs and fits(f.value):
                self.clauses.append((name, f"{{}} {signs[type(f)]} ?", [f.value]))
            elif plain and isinstance(f, In) and f.value and all(map(fits, f.value)):
                self.clauses.append((name, f"{{}} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif plain and isinstance(f, (IsNull, IsNotNull)):
                self.clauses.append((name, "{} IS NULL" if isinstance(f, IsNull) else "{} IS NOT NULL", []))
            else:
                yield f


_AFFINITY = {T.StringType: "TEXT", T.LongType: "INTEGER", T.DoubleType: "REAL"}
_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.ArrayType: pa.list_(pa.list_(pa.list_(pa.float64())))}


class LayerFiles(DataSource):
    """Options: path; layers (names, by commas; all if left out); rows (of a partition); push (true where the session hands filters on)."""

    @classmethod
    def name(cls) -> str:
        return "layers"

    def _wanted(self) -> list[str] | None:
        told = self.options.get("layers")
        return [x.strip() for x in told.split(",")] if told else None

    def schema(self) -> T.StructType:
        """layer, row, all columns of the layers by their first spelling, geometry."""
        found: dict[str, T.StructField] = {}
        with _open(self.options["path"]) as con:
            for name, layer in _layers(con).items():
                if self._wanted() is None or name in self._wanted():
                    for column, declared in layer["columns"].items():
                        kind = _type(declared)
                        known = found.get(column.lower())
                        if known is not None and known.dataType != kind:
                            kind = T.StringType()
                        found[column.lower()] = T.StructField(known.name if known else column, kind)
        own = [f for k, f in found.items() if k not in ("layer", "row", "geometry")]
        return T.StructType([T.StructField("layer", T.StringType()), T.StructField("row", T.LongType()), *own, T.StructField("geometry", RINGS)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("push", "false") == "true" else _Reader
        return kind(self.options["path"], schema, self._wanted(), int(self.options.get("rows", RANGE_ROWS)))


def layer_table(spark: SparkSession, path: str, layers: list[str] | None = None, schema: str | T.StructType | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """The layers of a file as one table: layer, row, columns, geometry; only the columns of a schema, where one is given."""
    spark.dataSource.register(LayerFiles)
    reader = spark.read.format("layers").option("rows", str(rows)).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled"))
    if layers:
        reader = reader.option("layers", ",".join(layers))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def occurrence_pages(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Records of stored pages of an occurrence service, each a JSON file {"offset", "results": [...]}: offset and the fields of every result.

    A page is one file and at least one partition's row; a page without results,
    or whose text is no such object, gives nothing.
    """
    from pyspark.sql import functions as F

    pages = spark.read.schema(f"offset long, results array<struct<{fields}>>").option("multiLine", "true").json(path)
    return pages.select("offset", F.inline("results"))
