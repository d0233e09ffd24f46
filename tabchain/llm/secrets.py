"""Secret scan: fixed patterns, and entropy over sliding windows of candidates.

Positions come from two passes of the same pattern: what ``split`` leaves between
the matches and what ``regexp_extract_all`` takes out of it alternate, so running
lengths are offsets. All of it is built from SQL functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabchain.llm.common import let

#: Patterns, the group whose length counts, and the least length. Fixed values.
KINDS = {
    "assign": (
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: What a text must hold at all for a kind to be looked for. Each is implied by a
#: match that is long enough, so it drops none.
NEEDED = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}

WINDOW = 20
#: Candidates of the entropy scan: whole runs that fill a window and hold a digit
#: and a letter.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{%d,}" % WINDOW
)
#: Character classes in the order in which they are tried: the first whose
#: alphabet holds the whole candidate decides. Least entropy in bits per class.
CLASSES = (
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    ("upper", r"^[0-9A-Z]+$", 3.4),
    ("lower", r"^[0-9a-z]+$", 3.5),
    ("base64", r"", 3.8),
)
#: Parts of a run between '=', '_' and '-' that are judged by their own class too,
#: as a value is that is glued to its name: those of a class below the last.
PART = r"(?<![A-Za-z0-9+/])(?=[a-z]*[A-Z]*[0-9])(?=[0-9]*[A-Za-z])(?:[0-9a-z]{%d,}|[0-9A-Z]{%d,})(?![A-Za-z0-9+/])" % (
    WINDOW,
    WINDOW,
)
#: Candidates that are no secrets: ids with dashes, words joined by separators,
#: words with a short number, and well-known placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*(?:[/_=+-]+[A-Za-z]*)*[0-9]{0,6}$",
    r"^[0-9/_=+-]+[A-Za-z]{0,3}$",
    r"(?i)example|placeholder|changeme|xxxxxx|0123456789|abcdefghij",
    r"(?i)^(?:https?|www|utm)[/_=-]",
)
#: Entropies are sums of whole numbers, so that no order of adding shows.
SCALE = 1_000_000
_WEIGHTS = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


EMPTY = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
_CHUNK = 256


def offsets(lengths: Column) -> Column:
    """Sum of all lengths before each position.

    Summed in runs of ``_CHUNK``, so that a text with very many matches doesn't
    copy its whole list once per match.
    """
    def before(values: Column, base: Column) -> Column:
        sums = F.aggregate(
            values,
            F.array(base),
            lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n),
        )
        return F.slice(sums, F.lit(1), F.size(values))

    def summed(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(runs, before(totals, F.lit(0)), before))

    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(_CHUNK)),
        lambda first: F.slice(lengths, first + 1, F.lit(_CHUNK)),
    )
    return let(runs, summed)


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start int, value string>>``, in code points."""

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        return let(F.transform(gaps, lambda g: F.length(g)), lambda g: between(g, values))

    def between(gaps: Column, values: Column) -> Column:
        steps = F.zip_with(gaps, values, lambda g, v: g + F.length(v))
        return let(
            steps,
            lambda n: F.zip_with(
                F.zip_with(offsets(n), gaps, lambda a, g: a + g),
                values,
                lambda start, v: F.struct(start.alias("start"), v.alias("value")),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _span(start: Column, kind_no: int, end: Column, kind: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        F.lit(kind_no).alias("kind_no"),
        end.cast("int").alias("end"),
        F.lit(kind).alias("kind"),
    )


def base_spans(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    number = list(KINDS).index(kind)
    kept = F.filter(
        matches(text, pattern),
        lambda m: F.length(F.regexp_extract(m["value"], pattern, group)) >= least
        if group
        else F.length(m["value"]) >= least,
    )
    spans = F.transform(
        kept, lambda m: _span(m["start"], number, m["start"] + F.length(m["value"]), kind)
    )
    return F.when(F.rlike(text, F.lit(NEEDED[kind])), spans).otherwise(F.array().cast(EMPTY))


def _limit(value: Column) -> Column:
    """Largest sum of count weights that the candidate's class lets a window have."""
    chosen = F.lit(None).cast("long")
    for _, alphabet, bits in reversed(CLASSES):
        most = F.lit(math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)).cast("long")
        chosen = F.when(F.rlike(value, F.lit(alphabet)), most).otherwise(chosen) if alphabet else most
    return chosen


def high_windows(value: Column) -> Column:
    """``struct<first, last>``: starts of the first and last window of high entropy, or -1.

    A window slides over the candidate by one character at a time. The counts of
    its characters, and the sum of count weights, change only by the character
    that enters and the one that leaves.
    """
    codes = F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""),
        lambda c: F.instr(F.lit(_ALPHABET), c) - 1,
    )
    return let(_limit(value), lambda most: let(codes, lambda c: _slid(c, most)))


def _slid(codes: Column, most: Column) -> Column:
    weights = F.array(*[F.lit(w).cast("long") for w in _WEIGHTS])
    start = F.struct(
        F.array_repeat(F.lit(0), len(_ALPHABET)).alias("counts"),
        F.lit(0).cast("long").alias("sum"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def slide(acc: Column, i: Column) -> Column:
        entering = F.get(codes, i)
        leaving = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1)
        counts = F.transform(
            acc["counts"],
            lambda c, j: c + F.when(j == entering, 1).otherwise(0) - F.when(j == leaving, 1).otherwise(0),
        )
        n_in, n_out = F.get(acc["counts"], entering), F.get(acc["counts"], leaving)
        less = F.when(leaving >= 0, F.get(weights, n_out - 1) - F.get(weights, n_out)).otherwise(
            F.lit(0).cast("long")
        )
        total = F.when(entering == leaving, acc["sum"]).otherwise(
            acc["sum"] + F.get(weights, n_in + 1) - F.get(weights, n_in) + less
        )
        high = (i >= WINDOW - 1) & (total <= most)
        at = i - (WINDOW - 1)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(high & (acc["first"] < 0), at).otherwise(acc["first"]).alias("first"),
            F.when(high, at).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(codes) - 1),
        start,
        slide,
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")),
    )


def suspect(m: Column) -> Column:
    return ~reduce(lambda a, b: a | b, [F.rlike(m["value"], F.lit(p)) for p in ALLOWED])


def run_windows(run: Column) -> Column:
    """``array<struct<start, end>>`` of a candidate run: of the whole run and of its parts.

    Of a span inside another one, or equal to it, only the other is kept.
    """
    separated = F.rlike(run["value"], F.lit("[=_-]")) & F.rlike(run["value"], F.lit(PART))
    none = F.array().cast("array<struct<start:int,value:string>>")
    parts = F.when(separated, F.filter(matches(run["value"], PART), suspect)).otherwise(none)
    whole = F.array(F.struct(F.lit(0).alias("start"), run["value"].alias("value")))
    scored = F.transform(
        F.concat(whole, parts), lambda m: F.struct(m["start"].alias("start"), high_windows(m["value"]).alias("w"))
    )
    spans = F.transform(
        F.filter(scored, lambda s: s["w"]["first"] >= 0),
        lambda s: F.struct(
            (run["start"] + s["start"] + s["w"]["first"]).alias("start"),
            (run["start"] + s["start"] + s["w"]["last"] + WINDOW).alias("end"),
        ),
    )

    def outer(found: Column) -> Column:
        return F.filter(
            found,
            lambda s: ~F.exists(found, lambda t: (t != s) & (t["start"] <= s["start"]) & (t["end"] >= s["end"])),
        )

    return let(F.array_distinct(spans), outer)


def candidates(text: Column) -> Column:
    """Candidate runs that the allow list doesn't suppress."""
    return F.when(
        F.rlike(text, F.lit(CANDIDATE)), F.filter(matches(text, CANDIDATE), suspect)
    ).otherwise(F.array().cast("array<struct<start:int,value:string>>"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)``: all spans of every row's whole text, by start, then kind.

    ``found`` is ``array<struct<start, kind_no, end, kind>>`` in code points, the end
    exclusive. Kinds ``assign``, ``access`` and ``hex`` are the matches of the fixed
    patterns that are long enough. Kind ``entropy`` covers, of a candidate run, the
    first to the last window whose Shannon entropy reaches the least one of the
    candidate's character class. A part of the run between '=', '_' and '-' that has a
    class of its own is judged by that too. Runs and parts on the allow list are left
    out, and so are spans inside a span of another kind.

    A null text counts as empty; an empty text has no span. Rows that repeat are
    scanned each for itself. Other columns are ignored. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    searched = docs.select(
        F.col(id_col).alias("doc_id"),
        F.concat(*[base_spans(text, kind) for kind in KINDS]).alias("base"),
        candidates(text).alias("candidates"),
    )
    scored = searched.select(
        "doc_id", "base", F.flatten(F.transform("candidates", run_windows)).alias("high")
    )
    number = len(KINDS)
    spans = F.transform("high", lambda s: _span(s["start"], number, s["end"], "entropy"))
    new = F.filter(
        spans,
        lambda s: ~F.exists(
            "base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])
        ),
    )
    return scored.select("doc_id", F.array_sort(F.concat("base", new)).alias("found"))
