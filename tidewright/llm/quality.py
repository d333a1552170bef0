"""Quality rules of single texts and of lines that many documents of a host share.

DataFrame functions only. The text is scanned once; what later steps need of
it (counts, and a hash and a word count for each line) is a thin table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import scratch

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Defaults of the rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed where more documents of its host than MAX_LINE_DOCS have it, however large the host.
MAX_LINE_DOCS = 20
#: A document is depleted when the removed lines hold more than this part of its words.
MAX_REMOVED_PERCENT = 70

#: What rows with the same verdict share; only doc_id may be null.
ROW_KEY = ["doc_id", "host", "text_hash"]


def words_by_line(text: Column) -> Column:
    """The words of each line; blanks are made one character first, as splits by a character need no regular expression."""
    for blank in BLANKS.replace(" ", "").replace("\n", ""):
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.transform(F.split(text, "\n"), lambda line: F.array_remove(F.split(line, " "), ""))


def line_hash(words: Column) -> Column:
    """Hash of a line in its normal form: A-Z as a-z, one space between words."""
    line = F.array_join(words, " ")
    # lower() reads bytes, but changes other letters than A-Z as well
    return F.xxhash64(F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)))


def text_measures(docs: DataFrame, host: str | Column) -> DataFrame:
    """A thin row for each document: the base counts, and line_rows of (line, words)."""
    host = F.col(host) if isinstance(host, str) else host
    texts = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    lines = texts.withColumns(
        {
            "tokens": words_by_line(F.col("text")),
            "lines": F.filter(F.split("text", "\n"), lambda line: F.ltrim(line, F.lit(BLANKS)) != ""),
        }
    )
    words = lines.withColumn("words", F.flatten("tokens"))
    windows = words.withColumn("windows", F.expr("slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))"))
    # only a text with a repeated window is sorted
    ranked = windows.withColumn(
        "ranked",
        F.expr("if(size(array_distinct(windows)) = size(windows), array(), sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))))"),
    )
    starts = ranked.withColumn(
        "starts",
        F.expr(
            "sort_array(transform(filter(ranked, (x, k) -> coalesce(get(ranked, k - 1).h = x.h, false) OR coalesce(get(ranked, k + 1).h = x.h, false)), x -> x.i))"
        ),
    )
    return starts.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "aggregate(zip_with(starts, slice(starts, 2, size(starts)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)"
        ).alias("n_repeat_words"),
        F.transform(
            F.filter("tokens", lambda own: F.size(own) > 0), lambda own: F.struct(line_hash(own).alias("line"), F.size(own).alias("words"))
        ).alias("line_rows"),
    )


def frequent_lines(measures: DataFrame, max_docs: int = MAX_LINE_DOCS, min_percent: float = 0.0, copies_once: bool = False) -> DataFrame:
    """(host, line) of the lines that more than max_docs distinct documents of their host have.

    A document is a doc_id, or a text where that is null; with copies_once it
    is a text, so exact copies don't make their own lines frequent. With
    min_percent a line also needs more than that part of the host's documents.
    Counts are made in two steps, first by (host, line, document), so a
    frequent line or a large host is spread over all tasks.
    """
    document = F.col("text_hash") if copies_once else F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias("t"))
    rows = measures.select("host", document.alias("document"), F.explode("line_rows.line").alias("line")).distinct()
    counts = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    if min_percent <= 0:
        return counts.select("host", "line")
    whole = measures.select("host", document.alias("document")).distinct().groupBy("host").agg(F.count("*").alias("documents"))
    return counts.join(whole, "host").where(100 * F.col("n") > min_percent * F.col("documents")).select("host", "line")


def _same_row(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left joined to right on ROW_KEY; a null doc_id equals a null doc_id."""
    named = right.withColumnsRenamed({c: f"__of_{c}" for c in ROW_KEY})
    same = F.col("doc_id").eqNullSafe(F.col("__of_doc_id"))
    for c in ROW_KEY[1:]:
        same = same & (F.col(c) == F.col(f"__of_{c}"))
    return left.join(named, same, how).drop(*[f"__of_{c}" for c in ROW_KEY])


def judged(
    docs: DataFrame,
    host: str | Column = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_line_docs: int = MAX_LINE_DOCS,
    min_line_percent: float = 0.0,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
    copies_once: bool = False,
) -> DataFrame:
    """A verdict for each row of docs: the base counts, base_failed, removed_words, removed, kept.

    A null text counts as empty, and so fails for its few words; a null host is
    a host of its own. Rows that repeat a doc_id, or have none, are judged each
    by its text; a repeated row is one document. Texts of any length are read
    whole. `removed` holds the hashes of the removed lines. An empty table
    gives an empty one; other columns are ignored, whatever their names.

    Lines find their counts by a shuffle join of thin rows; a line that very
    many documents of one host share makes a large partition of it, which
    Spark's adaptive skew join splits.
    """
    rows = scratch.table(text_measures(docs, host), "measures")
    frequent = frequent_lines(rows, max_line_docs, min_line_percent, copies_once)
    lines = rows.select(*ROW_KEY, F.explode("line_rows").alias("x")).select(*ROW_KEY, "x.*")
    # repeated rows are one here, and get the same verdict
    once = lines.groupBy(*ROW_KEY, "line").agg((F.sum("words") / F.count("*")).alias("each"), F.count("*").alias("times"))
    copies = rows.groupBy(*ROW_KEY).agg(F.count("*").alias("copies"))
    held = once.join(frequent, ["host", "line"]).groupBy(*ROW_KEY).agg(F.sum(F.col("each") * F.col("times")).alias("gone"), F.collect_list("line").alias("removed"))
    gone = _same_row(held, copies).withColumn("removed_words", F.round(F.col("gone") / F.col("copies")).cast("long")).select(*ROW_KEY, "removed_words", "removed")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        _same_row(rows.drop("line_rows"), gone, "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("removed_words") <= max_removed_percent * F.col("n_words")))
    )


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """docs without the rejected documents, and without the removed lines in the others.

    The columns of docs stay as they are, n_chars (if there) follows the text.
    A row with a null doc_id gets the verdict of its text and host; null, empty
    and very short texts go, as the base rules reject them; of repeated rows
    all stay or none. An empty table gives an empty one. Columns named __id,
    __hash, __host and __removed are not kept apart from the function's own.
    """
    verdict = judged(docs, host, **limits).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("host").alias("__host"), "kept", "removed"
    )
    verdict = verdict.where("kept").dropDuplicates(["__id", "__hash", "__host"]).select("__id", "__hash", "__host", F.col("removed").alias("__removed"))
    keyed = docs.withColumns({"__hash": F.xxhash64(F.coalesce("text", F.lit(""))), "__host": F.coalesce(F.col(host).cast("string"), F.lit(""))})
    joined = keyed.join(verdict, F.col("doc_id").eqNullSafe(F.col("__id")) & (keyed["__hash"] == verdict["__hash"]) & (keyed["__host"] == verdict["__host"]))
    held = F.arrays_zip(F.split("text", "\n").alias("line"), words_by_line(F.col("text")).alias("words"))
    stays = F.transform(F.filter(held, lambda x: ~F.array_contains("__removed", line_hash(x["words"]))), lambda x: x["line"])
    left = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    changed = joined.withColumn("text", left)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)
