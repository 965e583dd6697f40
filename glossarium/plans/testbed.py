"""The lexical tables that the queries run on, made of the tables there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import parsing, templates
from ..session import table
from ..sources import readers


def raw_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of documents: dict_id (language), source_path, line_no, raw."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("dict_id"))
    return readers.lines_of(docs, "text", F.concat(F.lit("doc/"), F.col("doc_id")), "dict_id")


def words(spark, sf_dir: str) -> DataFrame:
    """Headwords of the documents' lines by the word list template."""
    return templates.headwords(raw_lines(spark, sf_dir))


#: Digits of a document's number, of their count and of a line's number in a place.
_ID, _COUNT, _LINE = 19, 2, 10


def _place(doc_id: Column, line_no: Column) -> Column:
    """A number in the order of ('doc/' || doc_id, line_no), a null id before all: aggregates keep numbers of a fixed size in a
    hash table, where they would sort all rows for the least of texts. The first digit is 1 for null, 2 for ids below 0, 3
    for others; then come the digits of the id from the left, how many they are, and the line."""
    digits = F.ltrim(doc_id.cast("string"), F.lit("-"))
    kind = F.when(doc_id.isNull(), "1").when(doc_id < 0, "2").otherwise("3")
    parts = (F.rpad(digits, _ID, "0"), F.lpad(F.length(digits).cast("string"), _COUNT, "0"))
    text = F.concat(kind, *(F.coalesce(c, F.lit("0" * n)) for c, n in zip(parts, (_ID, _COUNT))), F.lpad(line_no.cast("string"), _LINE, "0"))
    return text.cast(f"decimal({1 + _ID + _COUNT + _LINE},0)")


def _of_place(place: Column) -> tuple[Column, Column]:
    """source_path and line_no of a place."""
    text = place.cast("string")
    kind, count = F.substring(text, 1, 1), F.substring(text, 2 + _ID, _COUNT).cast("int")
    digits = F.substr(text, F.lit(2), count)
    path = F.when(kind == "2", F.concat(F.lit("doc/-"), digits)).when(kind == "3", F.concat(F.lit("doc/"), digits))
    return path, F.substring(text, 2 + _ID + _COUNT, _LINE).cast("int")


def entries(spark, sf_dir: str) -> DataFrame:
    """One entry for each word's first place in a language: dict_id, source_path, line_no, headword_raw, entry_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("dict_id"))
    lines = readers.lines_of(docs, "text", F.lit(None).cast("string"), "dict_id", "doc_id")
    w = templates.headwords(lines.select("dict_id", "raw", _place(F.col("doc_id"), F.col("line_no")).alias("place")))
    first = w.groupBy("dict_id", F.col("headword").alias("headword_raw")).agg(F.min("place").alias("place"))
    path, line = _of_place(F.col("place"))
    out = first.select("dict_id", "headword_raw", path.alias("source_path"), line.alias("line_no"))
    return out.withColumn("entry_id", parsing.entry_id(F.col("dict_id"), F.col("source_path"), F.col("line_no"), F.col("headword_raw"), F.lit("p")))


def part_lines(spark, sf_dir: str) -> DataFrame:
    """Parts as dictionary lines, a source for each brand: some out of range, without comma, with a bad part of speech,
    and a section line before each hundred."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pos = F.element_at(F.array(*map(F.lit, ("a", "v", "p", "s", "x"))), (k % 5 + 1).cast("int"))
    entry = F.concat((k % 12).cast("string"), F.lit(" "), F.lower("p_name"), F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit(", ")), pos)
    line = F.when(k % 100 == 1, F.upper(F.substring(F.regexp_replace("p_name", "[^A-Za-z]", ""), 1, 2))).when(k % 97 == 0, k.cast("string")).otherwise(entry)
    return p.select(F.concat(F.lit("part/"), "p_brand").alias("source_path"), k.cast("int").alias("line_no"), line.alias("raw"))


def store(spark, sf_dir: str) -> DataFrame:
    """Parts as the entries of a store: three corpora, edits, missing and malformed values here and there."""
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    every = lambda n, value, other=None: F.when(k % n == 0, value).otherwise(other)
    features = F.concat(
        F.lit('{"prime_count":'), (k % 3).cast("string"), F.lit(',"accented_vowel_count":'), (k % 4).cast("string"), F.lit(',"stress":"'), every(2, "primary", "none"), F.lit('"}')
    )
    return table(spark, sf_dir, "part").select(
        k.cast("string").alias("entry_id"),
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dict_id"),
        F.col("p_brand").alias("section"),
        F.concat(F.lit("part/"), "p_brand").alias("source_path"),
        k.cast("int").alias("line_no"),
        (F.col("p_size") % 12).alias("syllables"),
        name.alias("headword_raw"),
        every(5, F.upper(name), F.when(k % 5 == 1, " ")).alias("headword_edit"),
        F.element_at(F.array(*map(F.lit, ("a", "v", "p", "s", "x"))), (k % 5 + 1).cast("int")).alias("pos_raw"),
        F.when(k % 4 != 0, kind).alias("pron_raw"),
        every(7, F.lower(kind)).alias("pron_edit"),
        F.col("p_brand").alias("definition_raw"),
        F.lit(None).cast("string").alias("definition_edit"),
        every(3, name).alias("form_display"),
        every(2, F.lower(name), "").alias("form_norm"),
        every(8, F.lower(name)).alias("headword_norm"),
        every(6, F.lower(kind)).alias("pron_norm"),
        every(9, kind).alias("pron_render"),
        F.when(k % 13 == 0, "{bad").when(k % 13 == 1, "[1]").otherwise(features).alias("features_json"),
        F.when(k % 4 == 1, "reviewed").when(k % 4 == 2, "validated").otherwise("auto").alias("status"),
        (k % 11 == 0).alias("is_deleted"),
        (k % 10 == 0).alias("manual_created"),
        F.when(k % 3 != 0, (k % 50).cast("int")).alias("page"),
        every(17, " ", F.upper(F.substring(name, 1, 1))).alias("alpha_bucket"),
    )


def marked(spark, sf_dir: str) -> DataFrame:
    """The store with headwords that bear accents, primes, marks and odd signs, as profiles look at them."""
    k, name = F.col("line_no"), F.col("headword_raw")
    text = F.when(k % 5 == 0, F.replace(name, F.lit("e"), F.lit("é"))).when(k % 5 == 1, F.concat(name, F.lit("'"))).when(k % 5 == 2, F.concat(F.lit("́"), name)).when(k % 5 == 3, F.concat(name, F.lit("☃%"))).otherwise(name)
    return store(spark, sf_dir).withColumns({"headword_raw": text, "headword_edit": F.lit(None).cast("string"), "pron_raw": F.when(k % 4 == 0, name), "pron_edit": F.lit(None).cast("string")})


def all_issues(spark, sf_dir: str) -> DataFrame:
    """Line issues of the parts' dictionary lines, as those of corpora by line number."""
    i = parsing.line_issues(parsing.classify(part_lines(spark, sf_dir)))
    return i.withColumn("dict_id", F.concat(F.lit("d"), (F.col("line_no") % 3).cast("string")))
