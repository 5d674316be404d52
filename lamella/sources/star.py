"""STAR tables: a text parser, a Python data source named ``star``, and writers."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window


@dataclass
class Block:
    """One data block: a table (``columns`` and ``rows``) or, without a loop, key/value pairs in one row."""

    name: str
    columns: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    loop: bool = False


_TOKEN = re.compile(r"'([^']*)'|\"([^\"]*)\"|(\S+)")


def tokens(line: str) -> list[str]:
    return [next(g for g in m.groups() if g is not None) for m in _TOKEN.finditer(line)]


def parse(text: str) -> list[Block]:
    """Blocks in file order; short rows are dropped, surplus tokens cut."""
    blocks: list[Block] = []
    state = ""
    for raw in text.splitlines():
        line = raw.split("#")[0].strip() if raw.lstrip().startswith(("#", "_")) else raw.strip()
        if not line:
            if state == "rows":
                state = ""
            continue
        if line.startswith("data_"):
            blocks.append(Block(line[5:]))
            state = ""
        elif line == "loop_":
            blocks[-1].loop, state = True, "names"
        elif line.startswith("_") and blocks and state != "rows":
            parts = tokens(line)
            if blocks[-1].loop:
                blocks[-1].columns.append(parts[0][1:])
            else:
                blocks[-1].columns.append(parts[0][1:])
                blocks[-1].rows = [[*(blocks[-1].rows[0] if blocks[-1].rows else []), parts[1] if len(parts) > 1 else ""]]
        elif blocks and blocks[-1].loop:
            state = "rows"
            parts = tokens(line)
            if len(parts) >= len(blocks[-1].columns):
                blocks[-1].rows.append(parts[: len(blocks[-1].columns)])
    return blocks


def particles_block(blocks: list[Block]) -> Block:
    """Block ``particles``, else the only table, else the longest."""
    tables = [b for b in blocks if b.loop]
    named = [b for b in tables if b.name == "particles"]
    if not tables:
        raise ValueError("no table in the file")
    return named[0] if named else max(tables, key=lambda b: len(b.rows))


def _type_of(values: list[str]):
    def fits(f):
        try:
            for v in values:
                f(v)
        except ValueError:
            return False
        return True

    return LongType() if values and fits(int) else DoubleType() if values and fits(float) else StringType()


def schema_of(block: Block) -> StructType:
    kinds = [_type_of([r[i] for r in block.rows]) for i in range(len(block.columns))]
    return StructType([StructField("_row", LongType()), *[StructField(c, k) for c, k in zip(block.columns, kinds, strict=True)]])


@dataclass
class Layout:
    """Where a block's table lies in a file, without its rows: columns, types, and (byte, row) every STEP bytes."""

    columns: list[str]
    kinds: list
    starts: list[tuple[int, int]]
    end: int
    pairs: list[str] | None = None


STEP = 8 << 20


def _fits(f, v: str) -> bool:
    try:
        f(v)
    except ValueError:
        return False
    return True


def layout(path: str, block: str | None = None) -> Layout:
    """One pass over a local or mounted file, a line at a time: nothing but the layout is held."""
    found: list[tuple[str, Layout, int]] = []
    with open(path, "rb") as f:
        at, name, names, state, now, rows, whole, numeric = 0, "", [], "", None, 0, [], []
        loop, pairs = False, []

        def close():
            nonlocal now, names, pairs, loop
            if now is not None:
                now.end = at
                now.kinds = [LongType() if i else DoubleType() if d else StringType() for i, d in zip(whole, numeric, strict=True)]
                found.append((name, now, rows))
            elif names and not loop:
                found.append((name, Layout(names, [LongType() if _fits(int, v) else DoubleType() if _fits(float, v) else StringType() for v in pairs], [], 0, pairs), 0))
            now, names, pairs, loop = None, [], [], False

        for raw in f:
            line = raw.decode("utf-8").strip()
            bare = line.split("#")[0].strip() if line.startswith(("#", "_")) else line
            if line.startswith("data_"):
                close()
                name, state = line[5:], ""
            elif line == "loop_":
                names, state, loop = [], "names", True
            elif line.startswith("_") and state != "rows":
                parts = tokens(bare)
                names.append(parts[0][1:])
                if not loop:
                    pairs.append(parts[1] if len(parts) > 1 else "")
            elif not bare:
                if state == "rows":
                    close()
                    state = ""
            elif names and loop and state in ("names", "rows"):
                parts = tokens(bare)
                if len(parts) >= len(names):
                    if now is None:
                        now, rows, state = Layout(names, [], [(at, 0)], 0), 0, "rows"
                        whole, numeric = [True] * len(names), [True] * len(names)
                    elif at - now.starts[-1][0] >= STEP:
                        now.starts.append((at, rows))
                    for i in range(len(names)):
                        whole[i] = whole[i] and _fits(int, parts[i])
                        numeric[i] = numeric[i] and (whole[i] or _fits(float, parts[i]))
                    rows += 1
            at += len(raw)
        close()
    if block is not None:
        return next(x for n, x, _ in found if n == block)
    tables = [t for t in found if t[1].pairs is None]
    if not tables:
        raise ValueError("no table in the file")
    return next((x for n, x, _ in tables if n == "particles"), max(tables, key=lambda t: t[2])[1])


class StarSource(DataSource):
    """``spark.read.format("star").option("block", "particles").load(path)`` for files on a mounted path; ``_row`` is the file
    order. A partition is a stretch of bytes that its task reads itself; for other stores see ``read_star``."""

    @classmethod
    def name(cls) -> str:
        return "star"

    def _layout(self) -> Layout:
        return layout(self.options["path"], self.options.get("block"))

    def schema(self) -> StructType:
        found = self._layout()
        return StructType([StructField("_row", LongType()), *[StructField(c, k) for c, k in zip(found.columns, found.kinds, strict=True)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return StarReader(self.options["path"], self._layout())


class StarReader(DataSourceReader):
    def __init__(self, path: str, found: Layout):
        self.path, self.found = path, found

    def partitions(self):
        return [InputPartition(i) for i in range(max(len(self.found.starts), 1))]

    def read(self, partition) -> Iterator[tuple]:
        cast = {LongType(): int, DoubleType(): float}
        f = [cast.get(k, str) for k in self.found.kinds]
        if self.found.pairs is not None:
            yield (0, *[g(v) for g, v in zip(f, self.found.pairs, strict=True)])
            return
        if not self.found.starts:
            return
        at, row = self.found.starts[partition.value]
        stops = [s for s, _ in self.found.starts[1:]] + [self.found.end]
        with open(self.path, "rb") as lines:
            lines.seek(at)
            while at < stops[partition.value]:
                raw = lines.readline()
                at += len(raw)
                parts = tokens(raw.decode("utf-8"))
                if len(parts) >= len(f):
                    yield (row, *[g(v) for g, v in zip(f, parts, strict=False)])
                    row += 1


def read_star(spark: SparkSession, path: str, block: str | None = None) -> DataFrame:
    """A block as a DataFrame with ``_row``, from any store Spark reads and in as many tasks as the file has splits.

    Names of blocks, labels and blank lines reach the driver, rows do not.
    """
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"))
    mark = F.col("line").rlike(r"^(data_|loop_$|_|$)")
    marks = [(r["s"], r["m"], r["line"]) for r in text.filter(mark).orderBy("s", "m").collect()]
    tables: list[dict] = []
    now: dict | None = None
    for i, (s, m, line) in enumerate(marks):
        adjoins = i > 0 and marks[i - 1][0] == s and marks[i - 1][1] + 1 == m
        if now and now.get("names") and "stop" not in now and now["loop"] and not adjoins and not line.startswith("_"):
            now["stop"] = (s, m)  # rows came before this mark
        if line.startswith("data_"):
            now = {"block": line[5:], "loop": False, "names": [], "pairs": []}
            tables.append(now)
        elif line == "loop_" and now is not None:
            now["loop"] = True
        elif line.startswith("_") and now is not None and "stop" not in now:
            if now["loop"] and now["names"] and not adjoins and now["start"] != (s, m):
                continue  # a row that begins with an underscore
            parts = tokens(line.split("#")[0])
            now["names"].append(parts[0][1:])
            now["pairs"].append(parts[1] if len(parts) > 1 else "")
            now["start"] = (s, m)
    key = F.struct("s", "m")
    after = lambda p: key > F.struct(F.lit(p[0]).cast("long").alias("s"), F.lit(p[1]).alias("m"))
    before = lambda p: key < F.struct(F.lit(p[0]).cast("long").alias("s"), F.lit(p[1]).alias("m"))

    def rows_of(t: dict) -> DataFrame:
        inside = after(t["start"]) & ~F.col("line").startswith("#") & (F.col("line") != "")
        if "stop" in t:
            inside &= before(t["stop"])
        quoted = F.expr("regexp_extract_all(line, '\\'[^\\']*\\'|\"[^\"]*\"|[^ \\t]+', 0)")
        plain = F.transform(quoted, lambda v: F.regexp_replace(v, "^(['\"])(.*)\\1$", "$2"))
        return text.filter(inside).select("s", "m", plain.alias("t")).filter(F.size("t") >= len(t["names"]))

    if block is not None:
        chosen = next(t for t in tables if t["block"] == block)
    else:
        loops = [t for t in tables if t["loop"] and t["names"]]
        if not loops:
            raise ValueError("no table in the file")
        chosen = next((t for t in loops if t["block"] == "particles"), None) or (loops[0] if len(loops) == 1 else max(loops, key=lambda t: rows_of(t).count()))
    names = chosen["names"]
    if not chosen["loop"]:
        return spark.createDataFrame([(0, *[_typed(v) for v in chosen["pairs"]])], schema_of(Block("", names, [chosen["pairs"]])))
    rows = rows_of(chosen)
    value = [F.col("t")[i] for i in range(len(names))]
    whole = [F.min(v.rlike(r"^[+-]?\d+$") & v.try_cast("long").isNotNull()) for v in value]
    number = [F.min(v.try_cast("double").isNotNull()) for v in value]
    stat = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"w{i}") for i, x in enumerate(whole)], *[x.alias(f"d{i}") for i, x in enumerate(number)]).orderBy("s").collect()  # a row a split
    kinds = ["long" if stat and all(r[f"w{i}"] for r in stat) else "double" if stat and all(r[f"d{i}"] for r in stat) else "string" for i in range(len(names))]
    first, total = F.lit(0).cast("long"), 0
    for r in stat:
        first, total = F.when(F.col("s") == r["s"], F.lit(total).cast("long")).otherwise(first), total + r["n"]
    row = first + F.row_number().over(Window.partitionBy("s").orderBy("m")) - 1
    return rows.select(row.alias("_row"), *[v.cast(k).alias(n) for v, k, n in zip(value, kinds, names, strict=True)])


def _typed(v: str):
    return int(v) if _fits(int, v) else float(v) if _fits(float, v) else v


def block_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a file's blocks, in order."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("m"))
    return [r[0].strip()[5:] for r in text.filter(F.trim("value").startswith("data_")).orderBy("s", "m").collect()]


def _cell(v) -> str:
    if v is None:
        return "<NA>"
    if isinstance(v, float):
        return f"{v:.6f}"
    v = str(v)
    return f'"{v}"' if " " in v or not v else v


def write_star(blocks: dict[str, DataFrame | dict], path: str, header: str | None = None) -> None:
    """One STAR file with all blocks in order; rows ordered by ``_row`` where there is one. Replaces the file atomically."""
    parent = os.path.dirname(os.path.abspath(path))
    os.makedirs(parent, exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.writelines(f"# {line}\n" for line in (header or "").splitlines())
        for name, b in blocks.items():
            f.write(f"\ndata_{name}\n\n")
            if isinstance(b, dict):
                f.writelines(f"_{k}\t{_cell(v)}\n" for k, v in b.items())
                continue
            rows = b.orderBy("_row").drop("_row") if "_row" in b.columns else b
            f.write("loop_\n" + "".join(f"_{c} #{i}\n" for i, c in enumerate(rows.columns, 1)))
            for r in rows.toLocalIterator():
                f.write("\t".join(map(_cell, r)) + "\n")
    os.replace(path + ".part", path)


def _cells(df: DataFrame) -> list:
    """Columns as text cells: missing values, six decimals, quotes where a text is empty or has blanks."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float"):
            v = F.format_string("%.6f", c)
        else:
            v = c.cast("string")
            v = F.when((v == "") | v.contains(" "), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
        out.append(F.when(c.isNull(), F.lit("<NA>")).otherwise(v))
    return out


def write_groups(df: DataFrame, keys: list[str], folder: str, name: str = "particles", folders: bool = False, drop: list[str] | None = None) -> list[str]:
    """One STAR file a combination of keys, named by them (with ``folders``, in a folder of its name), without the
    columns ``drop``; returns the sorted paths.

    Spark writes the files beside and they are renamed, so any store will do; the driver sees their names only.
    """
    spark = df.sparkSession
    out = df.drop("_row", *(drop or []))
    label = F.concat_ws("_", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in keys])
    order = F.col("_row").cast("long") if "_row" in df.columns else F.monotonically_increasing_id()
    rows = df.select(label.alias("label"), order.alias("o"), F.concat_ws("\t", *_cells(out)).alias("line"))
    head = f"\ndata_{name}\n\nloop_\n" + "\n".join(f"_{c} #{i}" for i, c in enumerate(out.columns, 1))
    labels = rows.select("label").distinct()
    rows = rows.unionByName(labels.select("label", F.lit(-1).cast("long").alias("o"), F.lit(head).alias("line")))
    rows = rows.withColumn("g", F.hex(F.xxhash64("label")))
    part = f"{folder.rstrip('/')}/.parts-{uuid.uuid4().hex}"
    rows.repartition("g").sortWithinPartitions("g", "label", "o").select("line", "g").write.partitionBy("g").text(part)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, done = path(part).getFileSystem(conf), []
    for r in rows.select("g", "label").distinct().collect():
        at = f"{folder.rstrip('/')}/{r['label']}/{r['label']}.star" if folders else f"{folder.rstrip('/')}/{r['label']}.star"
        fs.mkdirs(path(at).getParent())
        fs.delete(path(at), False)
        file = next(x.getPath() for x in fs.listStatus(path(f"{part}/g={r['g']}")) if x.getPath().getName().startswith("part-"))
        fs.rename(file, path(at))
        done.append(at)
    fs.delete(path(part), True)
    return sorted(done)


def file_path(c):
    """A file's path in one form, whichever reader tells it: local files without their scheme."""
    return F.regexp_replace(c, "^file:/+", "/")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line) of text files, line numbers from 0."""
    whole = spark.read.text(path, wholetext=True).select(file_path(F.col("_metadata.file_path")).alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
