"""Sources: text lines, CSV records, merged files, entry files and words with their places on a page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines_of(df: DataFrame, text: str, path: Column, *keep: str) -> DataFrame:
    """Lines of a text column: source_path, line_no from 1, raw."""
    cut = df.select(path.alias("source_path"), *keep, F.split(F.coalesce(text, F.lit("")), T.LINE_END, -1).alias("_parts"))  # once
    lines = cut.select("source_path", *keep, F.posexplode(T.whole_lines(F.col("_parts"))).alias("n", "raw"))
    return lines.select("source_path", *keep, (F.col("n") + 1).alias("line_no"), "raw")


def text_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Lines of all text files below a folder: source_path, line_no from 1, raw.

    Files are split as Spark splits them, at new lines; what other line ends a piece has (Unicode's, as ``split_lines``
    knows them) cut it further. A line's number is its place in its part of the file, raised by the lines of the parts
    before it: one row for each part, joined to the lines, so a file of any size is read by many tasks and no text is
    shuffled. The piece after a file's last line end is no line; whether a file ends in one, the bytes of its pieces and
    its size say. Bytes that are no UTF-8 are read as the replacement sign; empty files have no lines.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    pieces = read.select(
        F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("part"), F.col("_metadata.file_size").alias("file_size"),
        F.octet_length("value").alias("bytes"), F.regexp_replace(F.make_valid_utf8("value"), "\r\\z", "").alias("value"),
    )
    lines = pieces.select("source_path", "part", "file_size", "bytes", F.posexplode(F.split("value", T.LINE_END, -1)).alias("k", "raw"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    parts = lines.groupBy("source_path", "part").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("k") == 0, F.col("bytes") + 1)).alias("read"), F.max("file_size").alias("file_size")
    )
    whole = Window.partitionBy("source_path")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a byte order mark is skipped, so files may have three bytes more than their pieces; one less: the last piece has no end
    unended = (F.col("file_size") - F.sum("read").over(whole)).isin(-1, 2)
    parts = parts.select(F.col("source_path").alias("p"), F.col("part").alias("q"), (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("raise"), F.sum("n").over(whole).alias("total"), unended.alias("unended"))
    out = lines.join(parts, (F.col("source_path") == F.col("p")) & (F.col("part") == F.col("q"))).withColumn("line_no", F.col("at") + F.col("raise"))
    out = out.where(~(F.col("unended") & (F.col("line_no") == F.col("total")) & (F.col("k") > 0) & (F.col("raw") == "")))
    return out.select("source_path", F.col("line_no").cast("int").alias("line_no"), "raw")


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file_path, sha256 and the name <stem>-<12 digits of it><suffix> under which an import keeps each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    out = files.select("path", F.sha2("content", 256).alias("sha256"), stem.alias("stem"), suffix.alias("suffix"))
    return out.select("path", "sha256", F.concat("stem", F.lit("-"), F.substring("sha256", 1, 12), "suffix").alias("stored_name"))


def csv_records(rows: DataFrame, columns: list[str], source_path: str, order: str) -> DataFrame:
    """Records of a table as CSV records are read: all values text, numbered from 2 in the order given, the first six
    ``k=v`` as raw text. Numbers come from a count of the rows before each partition, not from one sorted task."""
    named = [(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    raw = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}="), v) for c, v in named[:6]))
    row = F.create_map(*(x for c, v in named for x in (F.lit(c), v)))
    return numbered(rows.select(order, raw.alias("raw"), row.alias("csv_row")), order, 2).select(F.lit(source_path).alias("source_path"), F.col("n").alias("record_no"), "raw", "csv_row")


def numbered(rows: DataFrame, order: str, start: int = 1) -> DataFrame:
    """Rows with n, their place in an order of unique values: sorted by range, numbered within each part, and raised by
    the sizes of the parts before (one number a part)."""
    parts = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    from ..session import stored

    parts = stored(parts, "ranges")
    sizes = sorted(parts.groupBy("_p").count().collect())
    before, at = {}, start
    for r in sizes:
        before[r["_p"]] = at
        at += r["count"]
    if not before:
        return rows.withColumn("n", F.lit(0).cast("long")).limit(0)
    table = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return parts.withColumn("n", (F.try_element_at(table, F.col("_p")) + F.col("_k")).cast("long")).drop("_p", "_k")


def merge_lines(lines: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Lines of several files in order of path and line; of equal lines the first stays. The first is a minimum, which
    combines before the shuffle."""
    if not deduplicate:
        return lines.select("source_path", "line_no", "raw")
    return lines.groupBy("raw").agg(F.min(F.struct("source_path", "line_no")).alias("at")).select("at.source_path", "at.line_no", "raw")


def entry_files(rows: DataFrame) -> DataFrame:
    """Entries of an entry file with defaults: part of speech v, one syllable, pronunciation from the headword, display
    and norm from the pronunciation."""
    get = lambda c: T.nonblank(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("string")
    head = T.strip(F.coalesce(get("headword"), F.lit("")))
    out = rows.withColumns({"headword_raw": head, "pos_raw": F.coalesce(get("pos"), F.lit("v")), "syllables": F.coalesce(get("syllables").try_cast("int"), F.lit(1))})
    out = out.withColumn("pron_raw", F.coalesce(get("pron"), F.col("headword_raw")))
    return out.withColumns({"form_display": F.coalesce(get("form_display"), F.col("pron_raw")), "form_norm": F.coalesce(get("form_norm"), F.col("pron_raw"))}).where("headword_raw <> ''")


def with_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with their page (source_path, line_no, page) if a source has as many pages as lines, else none."""
    n = lines.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    m = pages.groupBy("source_path").agg(F.count(F.lit(1)).alias("m"), F.count("page").alias("good"))
    ok = n.join(m, "source_path").where("n = m and m = good").select("source_path")
    return lines.join(pages.join(ok, "source_path", "left_semi"), ["source_path", "line_no"], "left")


def page_lines(words: DataFrame, columns: int = 1, tolerance: float = 2.5, width: float | None = None) -> DataFrame:
    """page, col, line_no and text of words (page, x0, top, text; with ``width`` a page's width): columns are cut in the
    middle of the widest gaps between the words' left edges, of equal gaps the left one; a page with too few edges or gaps
    has columns of equal width. Words within ``tolerance`` of a line's first word are on that line. Blank words are none."""
    if columns not in (1, 2, 3):
        raise ValueError("columns must be 1, 2 or 3")
    words = words.withColumn("text", T.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    edges = words.select("page", "x0").distinct()
    before = F.lag("x0").over(Window.partitionBy("page").orderBy("x0"))
    gaps = edges.withColumn("before", before).where("before is not null")
    # at most two cuts a page are kept, so the widest gaps are a bounded aggregate, not a sort of all
    widest = F.slice(F.array_sort(F.collect_list(F.struct((F.col("before") - F.col("x0")).alias("d"), "x0", ((F.col("x0") + F.col("before")) / 2).alias("cut")))), F.lit(1), F.lit(columns - 1))
    per = gaps.groupBy("page").agg(widest.alias("w"))
    equal = F.lit(float(width or 0)) if width else F.col("most")
    sizes = words.groupBy("page").agg(F.max("x0").alias("most"))
    even = F.array(*(equal * k / columns for k in range(1, columns))) if columns > 1 else F.array().cast("array<double>")
    cuts = sizes.join(per, "page", "left").select("page", F.when(F.size("w") >= columns - 1, F.transform("w", lambda g: g["cut"])).otherwise(even).alias("cuts"))
    placed = words.join(cuts, "page").withColumn("col", F.size(F.filter("cuts", lambda c: c <= F.col("x0"))))

    def lines(frames):
        """Lines of one sorted stream of words: a word further from its line's first than the tolerance begins the next."""
        at, words, number, done = None, [], 0, []

        def end():
            if words:
                done.append((*at[:2], number, " ".join(t for _, t in sorted(words))))

        for f in frames:
            for page, col, x0, top, text in zip(f.page, f.col, f.x0, f.top, f.text):
                fresh = at is None or (page, col) != at[:2]
                if fresh or top - at[2] > tolerance:
                    end()
                    at, words, number = (page, col, top), [], 1 if fresh else number + 1
                words.append((x0, text))
            yield pd.DataFrame(done, columns=["page", "col", "line_no", "text"])
            done = []
        end()
        yield pd.DataFrame(done, columns=["page", "col", "line_no", "text"])

    # many pages in a task, each whole and in order
    stream = placed.select("page", "col", "x0", "top", "text").repartition("page", "col").sortWithinPartitions("page", "col", "top", "x0", "text")
    return stream.mapInPandas(lines, "page long, col int, line_no int, text string")


def page_stats(lines: DataFrame, least: int = 4) -> DataFrame:
    """One row over lines (page, text): pages, pages with ``least`` characters or more, characters that are no white space,
    and a code where no page has text."""
    chars = F.length(F.regexp_replace("text", f"[{T.WS}]+", ""))
    per = lines.groupBy("page").agg(F.sum(chars).alias("chars"))
    out = per.agg(F.count(F.lit(1)).alias("pages_total"), F.count_if(F.col("chars") >= least).alias("pages_with_text"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    return out.withColumn("code", F.when(F.col("pages_with_text") == 0, "PDF_NO_TEXT_LAYER"))


def page_text(lines: DataFrame, source_path: str) -> DataFrame:
    """Lines (page, col, line_no, text) of a document as its text file has them, numbered over all pages in reading order,
    with the page of each: raw text and sidecar in one table. Pages are numbered by counts before them, without a sort of
    all lines in one task."""
    keyed = lines.withColumn("at", F.struct("page", "col", "line_no"))
    return numbered(keyed, "at").select(F.lit(source_path).alias("source_path"), F.col("n").cast("int").alias("line_no"), F.col("text").alias("raw"), "page")


def lexicon(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Distinct tokens of a word list, lower case; blank lines and those after # are none."""
    return lines.select(F.lower(T.strip(F.coalesce(raw, F.lit("")))).alias("token")).where("token <> '' and not startswith(token, '#')").distinct()


def csv_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Records of CSV files below a folder: source_path, record_no from 2, raw (the first six ``k=v``) and csv_row, all
    values as text, quoted line ends kept.

    Spark's own reader parses the files, each in one task as records may span lines, and streams them. Columns are those of
    a file's own first record, which joins the others by path; of columns of one name the last counts, values beyond the
    columns are left out, missing ones are empty. Blank lines are no records; where lines end in CR LF, those
    within values are read as LF.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    # no record has more values than the commas of its lines allow; lines of one record are together at least as wide
    widest = found.text(path).agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]
    width = 1 + (widest or 0)
    kinds = ", ".join(f"c{k} string" for k in range(width))
    rows = found.schema(kinds).option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    values = F.array(*(F.coalesce(f"c{k}", F.lit("")) for k in range(width)))
    rows = rows.select(F.col("_metadata.file_path").alias("source_path"), values.alias("values"), F.array(*(f"c{k}" for k in range(width))).alias("given")).withColumn("at", F.monotonically_increasing_id())
    heads = rows.groupBy("source_path").agg(F.min(F.struct("at", "given")).alias("h")).select(F.col("source_path").alias("p"), F.col("h.at").alias("first"), F.col("h.given").alias("names"))
    out = rows.join(heads, F.col("source_path") == F.col("p")).where("at > first")
    later = lambda n, k: F.array_contains(F.slice("names", k + 2, F.lit(width)), n)
    pairs = F.transform("names", lambda n, k: F.struct(n.alias("name"), F.get("values", k).alias("value"), later(n, k).alias("again")))
    pairs = F.filter(pairs, lambda e: e["name"].isNotNull() & ~F.coalesce(e["again"], F.lit(False)))
    out = out.withColumn("pairs", pairs)
    text = F.array_join(F.slice(F.transform("pairs", lambda e: F.concat(e["name"], F.lit("="), e["value"])), 1, 6), " | ")
    row = F.map_from_entries(F.transform("pairs", lambda e: F.struct(e["name"], e["value"])))
    return out.select("source_path", (F.col("at") - F.col("first") + 1).cast("int").alias("record_no"), row.alias("csv_row"), text.alias("raw"))


def copy_import(spark: SparkSession, path: str, to: str, glob: str = "*") -> list[str]:
    """Copies of a folder's files under names by their content, as an import keeps them; a name that is there is not
    written again. The driver copies, file by file, through Spark's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, out = jvm.org.apache.hadoop.fs.Path(to), []
    fs = target.getFileSystem(conf)
    for r in file_digests(spark, path, glob).orderBy("path").toLocalIterator():
        source, goal = jvm.org.apache.hadoop.fs.Path(r["path"]), jvm.org.apache.hadoop.fs.Path(f"{to}/{r['stored_name']}")
        if not fs.exists(goal):
            jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, goal, False, conf)
        out.append(goal.toString())
    return out


def zip_members(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder, and the members of those that are zip archives: path, member (null for a plain file), sha256 of
    what it holds, and content. What an archive is, its first bytes say, not its name; members that would leave the folder
    are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    def members(frames):
        import hashlib
        import io
        import zipfile

        for f in frames:
            for p, content in zip(f.path, f.content):
                rows = [(p, None, content)]
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(p, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("/") and ".." not in i.filename.split("/")]
                yield pd.DataFrame([(a, b, hashlib.sha256(c).hexdigest(), c) for a, b, c in rows], columns=["path", "member", "sha256", "content"])

    return files.select("path", "content").mapInPandas(members, "path string, member string, sha256 string, content binary")


# The suffixes of what can be dropped on an import.
DROPPED = {"zip": ("zip",), "pdf": ("pdf",), "image": ("tif", "tiff", "png", "jpg", "jpeg"), "text": ("txt",), "csv": ("csv",)}


def dropped_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct paths with their class by suffix: zip, pdf, image, text, csv, other."""
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    kind = F.lit(None).cast("string")
    for name, known in DROPPED.items():
        kind = F.coalesce(kind, F.when(suffix.isin(*known), name))
    return paths.select(path).distinct().withColumn("kind", F.coalesce(kind, F.lit("other")))
