"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines decides where a chunk
ends: a chunk starts where that hash is a local minimum, and a long line is a chunk
of its own. Both depend on nearby lines only, so a passage is cut alike wherever it
stands. Chunks of several lines, and long lines, that occur again anywhere are
removed but for their first occurrence, after their bytes were compared.

A passage of few short lines has no chunk of its own. ``short_runs`` looks for these
too: in each stretch of short lines, the shortest windows of 50 words from and up to
every line depend on nothing outside them, and together they cover every shared run
of 50 words or more, and no line beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabchain.llm.common import let, stored
from tabchain.llm.secrets import offsets

#: Blanks of a line from which it counts as long: 50 words.
LONG_LINE = 49
#: Words from which a run of short lines is a passage.
RUN_WORDS = 50
#: A chunk as one number: first line times this, plus the line after its last.
_BASE = 1 << 31
FARTHEST = (1 << 63) - 1


def rolled(hashes: Column) -> Column:
    """Cyclic rolling hash of each line and the one before; none before the first."""

    def pair(h: Column, i: Column) -> Column:
        before = F.get(hashes, i - 1)
        turned = F.shiftleft(before, 1).bitwiseOR(F.shiftrightunsigned(before, 63))
        return F.when(i > 0, turned.bitwiseXOR(h)).otherwise(F.lit(FARTHEST))

    return F.transform(hashes, pair)


def chunk_codes(lines: Column) -> Column:
    """Chunks of an array of lines as ``first * 2 ** 31 + end``."""
    hashes = F.transform(lines, lambda line: F.xxhash64(line))
    long = F.transform(
        lines, lambda line: (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))) >= LONG_LINE
    )

    def cut(r: Column, is_long: Column) -> Column:
        last = F.size(r) - 1
        starts = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == 0)
            | F.get(is_long, i)
            | F.get(is_long, F.greatest(i - 1, F.lit(0)))
            | (
                (F.get(r, i) < F.get(r, F.greatest(i - 1, F.lit(0))))
                & (F.get(r, i) <= F.coalesce(F.get(r, i + 1), F.lit(FARTHEST)))
            ),
        )
        return let(
            starts,
            lambda s: F.transform(
                s, lambda first, k: first.cast("long") * _BASE + F.coalesce(F.get(s, k + 1), last + 1)
            ),
        )

    return let(hashes, lambda h: let(rolled(h), lambda r: let(long, lambda is_long: cut(r, is_long))))


def first_line(code: Column) -> Column:
    return F.shiftright(code, 31).cast("int")


def line_count(code: Column) -> Column:
    return (code.bitwiseAND(F.lit(_BASE - 1)) - F.shiftright(code, 31)).cast("int")


def chunk_text(lines: Column, code: Column) -> Column:
    return F.array_join(F.slice(lines, first_line(code) + 1, line_count(code)), "\n")


def eligible(lines: Column, codes: Column) -> Column:
    """Chunks that may be removed, as ``(code, content)``."""
    with_text = F.transform(codes, lambda c: F.struct(c.alias("code"), chunk_text(lines, c).alias("content")))
    return F.filter(
        with_text,
        lambda c: (line_count(c["code"]) > 1)
        | (F.length(c["content"]) - F.length(F.replace(c["content"], F.lit(" "), F.lit(""))) >= LONG_LINE),
    )


def blanks(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))


def words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(blanks(line) + 1)


def stretches(lines: Column) -> Column:
    """Short lines between long ones, ``array<struct<first, lines>>``: those of ``RUN_WORDS`` words or more."""

    def between(breaks: Column) -> Column:
        spans = F.zip_with(
            F.slice(breaks, F.lit(1), F.size(breaks) - 1),
            F.slice(breaks, F.lit(2), F.size(breaks) - 1),
            lambda a, b: F.struct((a + 1).alias("first"), F.slice(lines, a + 2, b - a - 1).alias("lines")),
        )
        enough = F.filter(spans, lambda s: F.size(s["lines"]) > 1)
        return F.filter(
            enough, lambda s: F.aggregate(s["lines"], F.lit(0), lambda n, line: n + words(line)) >= RUN_WORDS
        )

    at = F.sequence(F.lit(0), F.size(lines) - 1)
    long = F.filter(at, lambda i: blanks(F.get(lines, i)) >= LONG_LINE)
    return let(F.concat(F.array(F.lit(-1)), long, F.array(F.size(lines))), between)


def _least(low: Column, high: Column, steps: Column, fits) -> Column:
    """Least number from ``low`` on that fits, or ``high``, by halving."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        open_ = acc["low"] < acc["high"]
        hit = fits(middle)
        return F.struct(
            F.when(open_ & ~hit, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(open_ & hit, middle).otherwise(acc["high"]).alias("high"),
        )

    start = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda acc: acc["low"])


def window_codes(first: Column, lines: Column) -> Column:
    """Shortest windows of ``RUN_WORDS`` words from each line on, and up to each line, as codes."""
    n = F.size(lines)
    at = F.sequence(F.lit(0), n - 1)
    steps = F.length(F.bin(n + 1))

    def found(before: Column, counts: Column) -> Column:
        upto = lambda j: F.get(before, j) + F.get(counts, j)
        code = lambda a, b: (first + a).cast("long") * _BASE + first + b
        ahead = F.transform(
            at,
            lambda i: let(
                _least(i, n, steps, lambda j: upto(j) - F.get(before, i) >= RUN_WORDS),
                lambda j: F.when(j < n, code(i, j + 1)),
            ),
        )
        back = F.transform(
            at,
            lambda j: let(
                _least(F.lit(0), j + 1, steps, lambda i: upto(j) - F.get(before, i) < RUN_WORDS),
                lambda i: F.when(i > 0, code(i - 1, j + 1)),
            ),
        )
        return F.array_distinct(F.filter(F.concat(ahead, back), lambda c: c.isNotNull()))

    return let(F.transform(lines, words), lambda counts: let(offsets(counts), lambda before: found(before, counts)))


def windows(cut: DataFrame) -> DataFrame:
    """``(row_key, place, code, hash, content)`` of every window of the cut documents."""
    spread = cut.select("row_key", "place", F.explode(stretches(F.col("lines"))).alias("s"))
    coded = spread.select(
        "row_key", "place", "s", F.explode(window_codes(F.col("s.first"), F.col("s.lines"))).alias("code")
    )
    content = F.array_join(
        F.slice(F.col("s.lines"), first_line(F.col("code")) - F.col("s.first") + 1, line_count(F.col("code"))), "\n"
    )
    return coded.select(
        "row_key", "place", "code", F.xxhash64(content).alias("hash"), content.alias("content")
    )


def repeated_runs(cut: DataFrame) -> DataFrame:
    """``(row_key, text_hash, runs)``: spans of windows that an earlier document holds too.

    Windows of equal hash but other bytes all stay.
    """
    found = windows(cut)
    document = F.xxhash64("row_key", "place.text_hash")
    # Hashes alone are counted first, so that contents move for shared windows only
    # where the list of these is small enough to be sent to all tasks.
    shared = (
        found.groupBy("hash")
        .agg(F.min(document).alias("least"), F.max(document).alias("most"))
        .filter("least <> most")
        .select("hash")
    )
    met = stored(found.join(stored(shared, "shared-windows"), "hash"), "shared-runs")
    first = (
        met.groupBy("hash", "content")
        .agg(F.min("place").alias("first"))
        .groupBy("hash")
        .agg(F.count("*").alias("contents"), F.min("first").alias("first"))
        .filter("contents = 1")
    )
    return (
        met.drop("content")
        .join(first.select("hash", "first"), "hash")
        .filter(F.col("place") != F.col("first"))
        .groupBy("row_key", F.col("place.text_hash").alias("text_hash"))
        .agg(F.collect_set("code").alias("runs"))
    )


def covered(codes: Column) -> Column:
    """Numbers of the lines that the spans cover, each once, in order."""
    each = F.transform(codes, lambda c: F.sequence(first_line(c), first_line(c) + line_count(c) - 1))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def joined_spans(codes: Column) -> Column:
    """Spans that overlap or meet, as one each."""

    def of(at: Column) -> Column:
        after = F.transform(at, lambda i: i + 1)
        starts, ends = F.array_except(at, after), F.array_except(after, at)
        return F.zip_with(starts, ends, lambda a, b: a.cast("long") * _BASE + b)

    return let(covered(codes), of)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short_runs: bool = False
) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated chunks.

    Two columns are added: ``removed_chunks``, an array of first line and number of
    lines, and ``total_lines``. Of equal chunks the one with the least (id, first
    line) stays, ids without a value last. A null text stays null, an empty one
    empty; they have no chunks to remove. Rows with the same id and text count as one
    document, each of which keeps the same lines. Chunks of equal digest but other
    bytes all stay. Other columns are kept, but for ones named as those added, which
    are replaced. No rows give no rows.

    With ``short_runs``, runs of lines under 50 words that hold 50 words or more
    together go too where an earlier document has them; removed spans that meet are
    one then. Repetitions within one document are found by chunks alone.
    """
    docs = docs.drop("removed_chunks", "total_lines")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    place = F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")
    )
    cut = docs.filter(F.col(text_col) != "").select(
        key.alias("row_key"), place.alias("place"), F.split(F.col(text_col), "\n").alias("lines")
    )
    chunks = cut.select(
        "row_key", "place", F.explode(eligible(F.col("lines"), chunk_codes(F.col("lines")))).alias("chunk")
    ).select(
        "row_key",
        "place",
        F.col("chunk.code").alias("code"),
        F.unhex(F.sha2(F.col("chunk.content"), 256)).alias("digest"),
        F.col("chunk.content").alias("content"),
    )
    # Whole contents are compared here, combined per task before they are shuffled.
    contents = (
        chunks.groupBy("digest", "content")
        .agg(F.min(F.struct("place", "code")).alias("first"), F.count("*").alias("n"))
        .groupBy("digest")
        .agg(F.max("n").alias("n"), F.count("*").alias("contents"), F.min("first").alias("first"))
        .filter("n > 1 and contents = 1")
    )
    repeated = stored(contents.select("digest", "first"), "repeated-chunks")
    gone = (
        chunks.select("row_key", "place", "code", "digest")
        .join(repeated, "digest")
        .filter(F.struct("place", "code") != F.col("first"))
        .groupBy("row_key", F.col("place.text_hash").alias("text_hash"))
        .agg(F.sort_array(F.collect_set("code")).alias("gone"))
    )
    if short_runs:
        none = F.array().cast("array<long>")
        both = F.concat(F.coalesce("gone", none), F.coalesce("runs", none))
        gone = gone.join(repeated_runs(cut), ["row_key", "text_hash"], "full").select(
            "row_key", "text_hash", joined_spans(both).alias("gone")
        )
    rows = docs.select(F.struct("*").alias("row"), key.alias("row_key"), F.xxhash64(text_col).alias("text_hash"))
    met = rows.join(gone, ["row_key", "text_hash"], "left")
    text = F.col("row").getField(text_col)

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered(F.col("gone")))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    cleaned = F.when(F.col("gone").isNull(), text).otherwise(let(F.split(text, "\n"), rest))
    spans = F.transform(
        F.coalesce("gone", F.array().cast("array<long>")),
        lambda c: F.struct(first_line(c).alias("first"), line_count(c).alias("lines")),
    )
    return met.select(
        *[(cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns],
        spans.alias("removed_chunks"),
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("total_lines"),
    )
