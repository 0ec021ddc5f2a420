"""Text-first scans with file lineage and row numbers."""

from __future__ import annotations

import csv
import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcemeld.operators.skew import sized_join
from sourcemeld.session import Scratch
from sourcemeld.settings import LIMITS, NA_TOKENS

LINEAGE = ("source_file", "source_row_number", "record_id")
#: Options that pick files; all others are the parser's.
FILE_OPTIONS = ("recursiveFileLookup", "pathGlobFilter", "modifiedBefore", "modifiedAfter")
READABLE = (".csv",)
ADMITTED = (".csv", ".xlsx")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder with size and admission; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return admission(files.select("path", "length"))


def admission(files: DataFrame) -> DataFrame:
    """Only ``.csv`` and ``.xlsx`` files are admitted; workbooks must be converted before the scan."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return files.withColumns(
        {
            "source_file": F.regexp_extract("path", r"([^/\\]+)$", 1),
            "accepted": suffix.isin(*ADMITTED),
            "readable": suffix.isin(*READABLE),
            "reason": F.when(~suffix.isin(*ADMITTED), F.concat(F.lit("Unsupported file type: "), F.when(suffix == "", "unknown").otherwise(suffix))),
        }
    )


def clean_missing(c: Column) -> Column:
    """Texts that a CSV reader takes as missing become NULL."""
    return F.when(~c.isin(*NA_TOKENS), c)


def data_name(name: str) -> str:
    """Name of a source column: its own, with blanks for underscores if lineage has a column of that name - the same label."""
    return name.replace("_", " ") if name in LINEAGE else name


def record_id(source_file: Column, row_number: Column) -> Column:
    """A stable, collision-free id that sorts like the rows of a file."""
    return F.concat(source_file, F.lit("#"), F.lpad(row_number.cast("string"), F.greatest(F.length(row_number.cast("string")), F.lit(12)), F.lit("0")))


def with_lineage(df: DataFrame, source_file: Column, row_number: Column) -> DataFrame:
    return df.withColumns({"source_file": source_file, "source_row_number": row_number.cast("bigint")}).withColumn(
        "record_id", record_id(F.col("source_file"), F.col("source_row_number"))
    )


def read_csv(spark: SparkSession, paths: str | list[str], multi_line: bool | None = None, *, root: str | None = None, **options) -> DataFrame:
    """CSV files of one header as text columns with ``source_file`` and ``source_row_number``.

    A file whose header differs from the others' fails the job; ``read_folder`` reads such files apart. ``source_file`` is a file's
    path below ``root``, by default below the path it was asked for by, so ids do not depend on what is read along; where
    that leaves two files with one name, ``root`` has to be given. The first data row is row 2.

    Files are split, line ends inside quotes or not. ``multi_line`` True leaves a file to one task and Spark's own reader; False does
    so with splits, for files known to have no quoted line ends.
    """
    if multi_line is None:
        frames = read_folder(spark, paths, root=root, **options)
        if len(frames) != 1:
            heads = [data_columns(f) for f in frames[:3]]
            raise ValueError(f"one header is needed, found {len(frames)}: {heads}; read_folder gives a frame for each header")
        return frames[0]
    _pin_splits(spark)
    raw = (
        spark.read.options(header=True, multiLine=multi_line, escape='"', encoding="UTF-8", enforceSchema=False, **options)
        .csv(paths)
    )
    placed = raw.select(
        *[clean_missing(F.col(f"`{n}`")).alias(data_name(n)) for n in raw.columns],
        F.col("_metadata.file_path").alias("__path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__place"),
    )
    before = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")
    blocks = Scratch(spark).write(
        placed.groupBy("__path", "__block")
        .agg(F.count(F.lit(1)).alias("__rows"), F.min("__place").alias("__first"))
        .select("__path", "__block", shift.alias("__shift"), file_below(spark, paths, root, F.col("__path")).alias("source_file")),
        "splits",
    )
    _check_names(blocks, "__path")
    known = F.when(F.col("__shift").isNull(), F.raise_error(F.lit("file splits changed while reading")).cast("bigint"))
    numbered = sized_join(placed, blocks, ["__path", "__block"], blocks.count()).withColumn(
        "source_row_number", known.otherwise(F.col("__place") + F.col("__shift") + 2)
    )
    return numbered.withColumn("record_id", record_id(F.col("source_file"), F.col("source_row_number"))).drop(
        "__path", "__block", "__place", "__shift"
    )


def read_folder(spark: SparkSession, paths: str | list[str], *, root: str | None = None, **options) -> list[DataFrame]:
    """CSV files of any headers: one frame of text columns per header, with lineage as ``read_csv`` gives it.

    Large files are split although quoted values may hold line ends. Whether a line ends inside quotes depends on
    all lines before it, so a first pass tells for every split how it ends if it starts outside of quotes and if
    it starts inside; put one after the other, that gives the true start of each split and the number of records before it. A
    second pass cuts the lines into records, glues the few that reach over a split, and writes them once, by header. Blank lines
    are no records. What is kept on the driver are the different headers.
    """
    _pin_splits(spark)
    scratch = Scratch(spark)
    quote = Quotes(options.get("sep", options.get("delimiter", ",")))
    found = {k: v for k, v in options.items() if k in FILE_OPTIONS}
    lines = spark.read.options(lineSep="\n", **found).text(paths).select(
        F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 1 << 30)).otherwise(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    seen = scratch.write(lines.mapInArrow(quote.survey, quote.SURVEY), "survey")
    splits = scratch.write(_starts(seen, spark, paths, root), "splits")
    _check_names(splits, "path")
    heads = {r["head"]: _names(r["head"], quote.sep) for r in splits.where("head is not null").select("head").distinct().collect()}
    shapes = sorted({tuple(n) for n in heads.values()})
    if not shapes:
        return []
    shape_of = spark.createDataFrame([(h, shapes.index(tuple(n))) for h, n in heads.items()], "head string, shape int")
    splits = splits.join(F.broadcast(shape_of), "head", "left").select("path", "block", "inside", "before", "source_file", "shape")
    many = splits.count()
    placed = sized_join(lines.withColumn("place", F.monotonically_increasing_id()), splits, ["path", "block"], many)
    lost = F.when(F.col("before").isNull(), F.raise_error(F.lit("file splits changed while reading")).cast("bigint"))
    placed = placed.withColumn("before", lost.otherwise(F.col("before"))).where("shape is not null or before is null")
    if many > LIMITS.broadcast_rows:  # a shuffled join has lost the order of the lines
        placed = placed.repartition("path", "block").sortWithinPartitions("path", "block", "place")
    cut = scratch.write(placed.select("line", "source_file", "block", "inside", "before", "shape").mapInArrow(quote.cut, quote.RECORDS), "records")
    # Records of several splits: their pieces in order.
    pieces = cut.where("not whole").groupBy("source_file", "shape", "number").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces"))
    glued = pieces.select("source_file", "shape", "number", F.array_join("pieces.text", "\n").alias("text"))
    records = cut.where("whole").select("source_file", "shape", "number", "text").unionByName(glued).where("number > 0")
    records = records.withColumn("text", F.regexp_replace("text", "\r$", ""))
    kept = f"{scratch.root}/by-header"
    records.write.partitionBy("shape").parquet(kept)
    frames = []
    for i, names in enumerate(shapes):
        fields = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
        own = spark.read.schema("source_file string, number bigint, text string, shape int").parquet(kept).where(F.col("shape") == i)
        parsed = F.from_csv("text", fields.simpleString()[7:-1].replace(":", " "), {"escape": '"', **{k: str(v) for k, v in options.items() if k not in found}})
        row = own.select("source_file", "number", parsed.alias("row"))
        values = [clean_missing(F.col(f"row.c{k}")).alias(data_name(n)) for k, n in enumerate(names)]
        number = (F.col("number") + 1).alias("source_row_number")
        frames.append(row.select(*values, "source_file", number, record_id(F.col("source_file"), F.col("number") + 1).alias("record_id")))
    return frames


class Quotes:
    """Where records end: line ends outside of quotes. A quote opens a value only at its start."""

    SURVEY = "path string, block bigint, ends_inside array<boolean>, records array<bigint>, head string"
    RECORDS = "source_file string, block bigint, shape int, number bigint, whole boolean, text string"

    def __init__(self, sep: str = ",") -> None:
        self.sep = sep
        s = re.escape(sep)
        inner = '(?:[^"]|"")*+'
        fields = f'(?:"{inner}"(?!")[^{s}]*+{s}|[^"{s}][^{s}]*+{s}|{s})*+'
        self.opens = re.compile(f'{fields}"{inner}$')  # from outside
        self.stays = re.compile(f'{inner}(?:$|"(?!")[^{s}]*+{s}{fields}"{inner}$)')  # from inside

    def states(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each line whether its end is inside quotes, if the first line starts outside and if it starts inside."""
        quoted = np.array(['"' in t for t in texts], bool)
        out, into = np.zeros(len(texts), bool), np.ones(len(texts), bool)  # end of the line by its start: unquoted ones change nothing
        for i in np.flatnonzero(quoted):
            out[i], into[i] = bool(self.opens.match(texts[i])), bool(self.stays.match(texts[i]))
        settled, flips = out == into, out & ~into
        turned = np.cumsum(flips)
        last = np.maximum.accumulate(np.where(settled, np.arange(len(texts)), -1))
        since = turned - np.where(last >= 0, turned[last], 0)
        return tuple(np.where(last >= 0, out[last], start) ^ (since % 2 == 1) for start in (False, True))

    def _by_split(self, batches, keys: list[str]):
        """(first row's values, lines) of each run of lines of one split within a batch, in order."""
        for batch in batches:
            table = pa.Table.from_batches([batch])
            blocks, owners = table.column("block").to_numpy(), table.column(keys[0]).to_pylist()
            texts = table.column("line").to_pylist()
            edges = [0, *(i for i in range(1, len(texts)) if blocks[i] != blocks[i - 1] or owners[i] != owners[i - 1]), len(texts)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    yield {k: table.column(k)[a].as_py() for k in ("block", *keys)}, texts[a:b]

    def survey(self, batches):
        """Lines -> for each split how it ends and how many records end in it, by its start, and the first record of a file."""
        open_split = None

        def row():
            s = open_split
            return pa.RecordBatch.from_pylist(
                [{"path": s["path"], "block": s["block"], "ends_inside": s["ends"], "records": s["records"], "head": "\n".join(s["head"]) if s["block"] == 0 and s["head"] else None}],
                schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("ends_inside", pa.list_(pa.bool_())), ("records", pa.list_(pa.int64())), ("head", pa.string())]),
            )

        for key, texts in self._by_split(batches, ["path"]):
            if open_split is None or (key["path"], key["block"]) != (open_split["path"], open_split["block"]):
                if open_split is not None:
                    yield row()
                open_split = {**key, "ends": [False, True], "records": [0, 0], "head": [], "headed": False}
            states = self.states(texts)
            for h in (0, 1):
                inside = states[int(open_split["ends"][h])]
                starts = np.concatenate(([open_split["ends"][h]], inside[:-1]))
                blank = np.array([not t.strip() for t in texts], bool) & ~starts
                open_split["records"][h] += int((~inside & ~blank).sum())
                if h == 0 and not open_split["headed"]:
                    for t, was, now in zip(texts, starts, inside):
                        if not was and not t.strip() and not open_split["head"]:
                            continue
                        open_split["head"].append(t)
                        if not now:
                            open_split["headed"] = True
                            break
                open_split["ends"][h] = bool(inside[-1])
        if open_split is not None:
            yield row()

    def cut(self, batches):
        """Lines of splits whose start is known -> records; those that a split has only a piece of are not whole."""
        schema = pa.schema([("source_file", pa.string()), ("block", pa.int64()), ("shape", pa.int32()), ("number", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
        key, held, first, number, inside = None, [], False, 0, False

        def record(whole: bool):
            return (key["source_file"], key["block"], key["shape"], number, whole, "\n".join(held))

        for mine, texts in self._by_split(batches, ["source_file", "inside", "before", "shape"]):
            rows = []
            if key is None or (mine["source_file"], mine["block"]) != (key["source_file"], key["block"]):
                if held:
                    rows.append(record(False))
                key, held, number, inside = mine, [], mine["before"], mine["inside"]
                first = inside  # the first record began before this split
            ends = self.states(texts)[int(inside)]
            for t, now in zip(texts, ends):
                if not held and not first and not inside and not now and not t.strip():
                    continue
                held.append(t)
                if not now:
                    rows.append(record(not first))
                    held, first, number = [], False, number + 1
                inside = now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(record(False), schema)], schema=schema)


def _starts(seen: DataFrame, spark: SparkSession, paths, root: str | None) -> DataFrame:
    """(path, block, inside, before, head, source_file): how every split starts and how many records end before it."""
    mine = Window.partitionBy("path").orderBy("block")
    earlier = mine.rowsBetween(Window.unboundedPreceding, -1)
    # A split settles the state, flips it or leaves it: the state at a start is the last settled one and the flips since.
    out, into = F.col("ends_inside")[0], F.col("ends_inside")[1]
    flips = F.sum((out & ~into).cast("int"))
    shown = seen.withColumn("turned", flips.over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    settled = F.when(out == into, F.struct(out.cast("int").alias("state"), F.col("turned")))
    shown = shown.withColumns({"last": F.last(settled, ignorenulls=True).over(earlier), "until": F.coalesce(F.lag("turned").over(mine), F.lit(0))})
    state = F.coalesce(F.col("last.state"), F.lit(0)) + F.col("until") - F.coalesce(F.col("last.turned"), F.lit(0))
    shown = shown.withColumn("inside", state % 2 == 1)
    ended = F.when(F.col("inside"), F.col("records")[1]).otherwise(F.col("records")[0])
    return shown.select(
        "path", "block", "inside", F.coalesce(F.sum(ended).over(earlier), F.lit(0)).alias("before"),
        F.first("head", ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("head"),
        file_below(spark, paths, root, F.col("path")).alias("source_file"),
    )


def _names(head: str, sep: str) -> list[str]:
    """Column names of a header, told apart where they are empty or repeated."""
    cells = next(csv.reader(io.StringIO(head.removesuffix("\r"), newline=""), delimiter=sep), [])
    folded = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def file_below(spark: SparkSession, paths: str | list[str], root: str | None, path: Column) -> Column:
    """Path of a file below ``root``, or below the one of ``paths`` it was found by: below a folder, or the bare name of a file."""
    folders = set()
    for given in [root] if root else [paths] if isinstance(paths, str) else paths:
        given = re.split(r"[^/]*[*?\[{]", given, maxsplit=1)[0]  # of a pattern the part without signs
        at = spark._jvm.org.apache.hadoop.fs.Path(given)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = files.makeQualified(at)
        folders.add((whole if files.getFileStatus(at).isDirectory() else whole.getParent()).toString().rstrip("/"))
    clean = F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "/+", "/")
    below = F.element_at(F.split(clean, "/"), -1)
    for folder in sorted(folders, key=len):  # the longest that fits decides
        lead = re.sub("/+", "/", folder + "/")
        below = F.when(F.startswith(clean, F.lit(lead)), F.substring(clean, len(lead) + 1, 1 << 30)).otherwise(below)
    return below


def _check_names(splits: DataFrame, path: str) -> None:
    twice = splits.groupBy("source_file").agg(F.count_distinct(path).alias("n")).where("n > 1").select("source_file").limit(5).collect()
    if twice:
        raise ValueError(f"several files are called {[r.source_file for r in twice]}; give the root below which they are told apart")


def _pin_splits(spark: SparkSession) -> None:
    """Fix the parallelism that split planning starts from, unless the session has done so."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))


def read_parquet(spark: SparkSession, paths: str | list[str], *, root: str | None = None) -> DataFrame:
    """Parquet files as text columns; the format knows its row index, so no pass is needed. Files are named as in ``read_csv``."""
    listed = [paths] if isinstance(paths, str) else paths
    raw = spark.read.parquet(*listed)
    texts = [clean_missing(F.col(f"`{n}`").cast("string")).alias(data_name(n)) for n in raw.columns]
    placed = raw.select(
        *texts, file_below(spark, paths, root, F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    return with_lineage(placed, F.col("__file"), F.col("__row") + 2).drop("__file", "__row")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LINEAGE]


def stack_sources(frames: list[DataFrame]) -> DataFrame:
    """One data set out of many, columns by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows as JSON text, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
