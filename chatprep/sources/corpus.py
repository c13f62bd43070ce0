"""Files as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions.text import one_line_break
from chatprep.operators.running import running_totals
from chatprep.rules import TRUNCATED
from chatprep.sources.store import Store, located, open_store
from chatprep.sources.walk import spark_files, walk

#: Largest file that is one row: its text may be three times as long where its bytes are no UTF-8.
ROW_BYTES = 1 << 29
#: Bytes of a file that are one task's run of it, and bytes that a task is dealt in all.
RANGE_BYTES = 1 << 26
TASK_BYTES = 1 << 27
#: Bytes that leave a reader at once.
FLUSH_BYTES = 1 << 22
TOO_LARGE_FOR_A_ROW = "too large for one row"


def _run_bytes(size: int) -> int:
    """Bytes of a run: as many ranges of ``size`` bytes as fit ``RANGE_BYTES``, one at least."""
    return size * max(1, RANGE_BYTES // size)


def _ranges(entries: DataFrame, size: int | None) -> DataFrame:
    """One row for each run of ranges of ``size`` bytes of each file, or for each whole file, dealt out evenly."""
    files = entries.where("kind = 'file'").select("path", "length")
    held = files.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES))
    if size is None:
        rows = files.select("*", F.lit(0).cast("long").alias("run"), F.lit(1).cast("long").alias("n_runs"))
        return rows.repartition(tasks, "path").sortWithinPartitions("path")
    n = F.greatest(F.ceil(F.col("length") / _run_bytes(size)).cast("long"), F.lit(1).cast("long"))
    rows = files.withColumn("n_runs", n)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_runs") - 1)).alias("run"))
    # A file's runs are spread, and those of one task are read file by file.
    spread = F.floor(F.col("run") * _run_bytes(size) / TASK_BYTES)
    return rows.repartition(tasks, "path", spread).sortWithinPartitions("path", "run")


def _read(ranges: DataFrame, store: Store, size: int | None) -> DataFrame:
    """``path, length, run, part, content, reason, lines``: whole lines of each range, or whole files.

    A task cuts a run into its ranges and counts the lines of the run before each range.
    """
    columns = ["path", "length", "run"]
    run_bytes = size and _run_bytes(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            types = [pa.string(), *[pa.int64()] * 3, pa.binary(), pa.string(), pa.int64()]
            cells = zip(*rows, strict=True) if rows else [[]] * len(types)
            arrays = [pa.array(cell, kind) for cell, kind in zip(cells, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [*columns, "part", "content", "reason", "lines"])

        with open_store(store) as opener:
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    path, length, number = row
                    if size is None:
                        part, end, pieces = 0, 1, opener.wholes(path, length)
                    else:
                        start = number * run_bytes
                        stop = min(start + run_bytes, length)
                        part, end = start // size, max(-(-stop // size), start // size + 1)
                        pieces = opener.pieces(path, start, stop, size, length)
                    lines, reason = 0, None
                    while part < end:
                        content = None
                        if reason is None:
                            try:
                                content = next(pieces)
                            except OSError as error:
                                reason = str(error)[:200]
                        rows.append((*row, part, content, reason, lines))
                        part += 1
                        if content:
                            held += len(content)
                            # Nobody asks for the lines before the next whole file.
                            lines += 0 if size is None or part == end else _lines(content)
                        held += 100
                        if held >= FLUSH_BYTES:
                            yield out()
                            rows, held = [], 0
        yield out()

    schema = "path string, length long, run long, part long, content binary, reason string, lines long"
    return ranges.select(*columns).mapInArrow(run, schema)


def _lines(content: bytes) -> int:
    """What ``line_count`` counts in the text of a piece, bytes that are not UTF-8 left out."""
    if content.endswith(b"\n") and b"\r" not in content:
        return content.count(b"\n")
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode(errors="replace").replace("\ufffd", "")
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.count("\n") + (text != "" and not text.endswith("\n"))


def corpus_files(spark: SparkSession, path: str, max_bytes: int = ROW_BYTES) -> DataFrame:
    """All files below a folder, or one file: ``path`` relative to it, ``length``, ``content``, ``reason``.

    Names don't matter: tasks list and open the files, see ``walk``. Files above
    ``max_bytes`` have no content here, with the reason; ``text_parts`` has them in
    pieces. Neither have files that can't be opened. In a store that only Spark opens
    (one that PyArrow does not know) the files are those that Spark's reader sees.
    """
    store = located(spark, path)
    if store is None:
        return spark_files(spark, path).withColumn("reason", F.lit(None).cast("string"))
    entries = walk(spark, path)
    small = entries.where(F.col("length") <= max_bytes)
    read = _read(_ranges(small, None), store, None).select("path", "length", "content", "reason")
    none = F.lit(None).cast("binary").alias("content")
    large = entries.where(F.col("length") > max_bytes).select("path", "length", none, F.lit(TOO_LARGE_FOR_A_ROW).alias("reason"))
    unread = entries.where("kind = 'unread'").select("path", "length", none, "reason")
    return read.unionByName(large).unionByName(unread)


def unread_files(spark: SparkSession, path: str) -> DataFrame:
    """What below a folder can't be listed or opened: ``path, length, reason``. Each file is opened, none is read."""
    store = located(spark, path)
    entries = walk(spark, path)
    unread = entries.where("kind = 'unread'").select("path", "length", "reason")
    if store is None:
        return unread
    tried = entries.withColumns({"_length": F.col("length"), "length": F.lit(0).cast("long")})
    tried = _read(_ranges(tried, None), store, None).where("reason IS NOT NULL").select("path", "reason")
    files = entries.where("kind = 'file'").select("path", "length")
    return unread.unionByName(files.join(tried, "path"))


def text_parts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files of any size as pieces of whole lines: ``path, length, part, text, lines_before``.

    A file is cut into ranges of bytes, and a range has the lines that begin in it, so a
    piece may be empty, and is as long as its longest line asks for. A task reads a run of
    ranges at once, 64 MB or one range, and counts lines inside it. ``lines_before`` counts
    the file's lines before the piece, by a running sum of the runs' line counts; only files
    of more than one run are read a second time for it. Bytes that are not UTF-8 are left
    out. Files that can't be opened have a null text.
    """
    store = located(spark, path)
    if store is None:
        whole = spark_files(spark, path)
        text = valid_text(F.col("content"), ignore=True).alias("text")
        zero = F.lit(0).cast("long")
        return whole.select("path", "length", zero.alias("part"), text, zero.alias("lines_before"))
    ranges = _ranges(walk(spark, path), range_bytes)
    text = valid_text(F.col("content"), ignore=True).alias("text")
    short, long = (
        _read(ranges.where(which), store, range_bytes).select("path", "length", "run", "part", text, "lines")
        for which in ("n_runs = 1", "n_runs > 1")
    )
    counted = _read(ranges.where("n_runs > 1"), store, _run_bytes(range_bytes)).select("path", "run", text)
    counted = counted.select("path", "run", F.coalesce(line_count(F.col("text")), F.lit(0)).alias("_lines"))
    before = running_totals(
        counted, ["path"], ["run"], F.floor(F.col("run") / 1000), {"_upto": F.col("_lines")}
    ).select("path", "run", (F.col("_upto") - F.col("_lines")).alias("_before"))
    long = long.join(before, ["path", "run"], "left")
    columns = ["path", "length", "part", "text"]
    return short.select(*columns, F.col("lines").alias("lines_before")).unionByName(
        long.select(*columns, (F.col("lines") + F.coalesce("_before", F.lit(0))).cast("long").alias("lines_before"))
    )


def line_count(text: Column) -> Column:
    """Lines of a text; what follows the last line break is one if it is not empty."""
    text = one_line_break(text)
    breaks = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    open_line = (text != "") & ~F.endswith(text, F.lit("\n"))
    return (breaks + open_line.cast("int")).cast("long")


def valid_text(content: Column, ignore: bool = False) -> Column:
    """Bytes as text; bytes that are not UTF-8 become replacement characters, or are left out."""
    text = F.make_valid_utf8(content.cast("string"))
    if not ignore:
        return text
    # A character that was there before must stay: only texts with bad bytes lose any.
    bad = ~F.is_valid_utf8(content.cast("string"))
    return F.when(bad, F.replace(text, F.lit("\ufffd"), F.lit(""))).otherwise(text)


def head_lines(text: Column, max_lines: int) -> tuple[Column, Column]:
    """The first lines with a mark where more follow, and whether more follow."""
    text = one_line_break(text)
    head = F.substring_index(text, "\n", max_lines)
    cut = F.char_length(text) > F.char_length(head) + 1
    mark = F.lit(TRUNCATED.format(n=max_lines))
    return F.when(cut, F.concat(head, mark)).otherwise(text), cut


def limit_texts(
    files: DataFrame, max_bytes: int | None = None, max_lines: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Texts, whole unless ``max_lines`` cuts them, and the files without a text or too large.

    ``files`` holds ``path, length, text``, and ``reason`` if it is known why a text is not
    there. ``n_lines`` counts lines of text, without the mark of a cut. Nothing is cut or
    refused unless asked for; a report cuts after ``rules.MAX_LINES`` lines and refuses
    above ``rules.MAX_FILE_BYTES``.
    """
    if max_lines is None:
        text, cut = one_line_break(F.col("text")), F.lit(False)
    else:
        text, cut = head_lines(F.col("text"), max_lines)
    there = F.col("text").isNotNull()
    small = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    n_lines = F.when(F.col("truncated"), F.lit(max_lines)).otherwise(line_count(F.col("shown")))
    texts = (
        files.where(there & small)
        .select("path", "length", text.alias("shown"), cut.alias("truncated"))
        .select("path", "length", F.col("shown").alias("text"), "truncated", n_lines.cast("int").alias("n_lines"))
    )
    known = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    reason = F.when(there, "too large").otherwise(F.coalesce(known, F.lit("no text")))
    refused = files.where(~(there & small)).select("path", "length", reason.alias("reason"))
    return texts, refused


def read_corpus(
    spark: SparkSession, path: str, max_bytes: int | None = None, max_lines: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Text files of a folder, and those refused for size or not read; see ``limit_texts`` and ``corpus_files``."""
    files = corpus_files(spark, path)
    return limit_texts(files.withColumn("text", valid_text(F.col("content"))).drop("content"), max_bytes, max_lines)
