"""Secret scans with DataFrame functions only: fixed patterns, and entropy of character windows.

Matches are located natively by marking them in the text, splitting at the marks and adding up the
lengths of the parts: odd parts are matches. The mark is a private-use character; where a text holds it
itself, it is read as another one that no pattern has either, which moves nothing.

Candidate strings of the entropy scan are runs of 20 or more key characters. Each is of the first class
whose pattern it meets; a window slides over it while the counts of its characters, and with them the
entropy, are updated by the one that comes in and the one that goes out. The best window must reach the
class's threshold, and the candidate must not be on the allow-list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import packed

#: The base patterns, in the order in which kinds sort.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a minimum length in the pattern is the same as dropping shorter matches.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
MIN_ASSIGNED = 6

#: Candidates of the entropy scan, without the padding that may follow.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
WINDOW = 20
#: Classes by what a candidate holds, and the bits a character that its best window must reach. Windows of random strings
#: have about 3.0 (digits), 3.3 (hex), 3.7 (letters of one case), 3.85 (those and digits), 4.0 (both cases), 4.05 (all); the
#: longest plain words reach 3.6, paths and slugs 3.9.
CLASSES = (
    ("digits", r"^[0-9]+$", 3.25),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("letters", r"^[A-Za-z]+$", 4.0),
    ("words", r"^[^0-9]+$", 4.1),
    ("slug", r"^([^A-Z]*[+/_-][^A-Z]*|[^a-z]*[+/_-][^a-z]*)$", 3.95),
    ("lower", r"^[a-z0-9]+$", 3.6),
    ("upper", r"^[A-Z0-9]+$", 3.6),
    ("mixed", r"", 3.7),
)
#: Candidates that hold one of these, in any case, or have the shape of a UUID or a date are no secrets.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|your[_-]|xxxx|0123456789|123456789|abcdef|test[_-]"
    r"|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^\d{4}-\d{2}-\d{2}"
)

_MARK, _OTHER = "", ""


#: Parts of a text whose places are added up together; even, so that odd parts are matches in every block.
_BLOCK = 512


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """Array of (start, rank, finish, found) for the matches of a pattern that ``keep`` accepts; offsets in code points."""
    rank = KINDS.index(kind)
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,finish:int,found:string>>)")
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, part: n + F.char_length(part))

    def step(state: Column, part: Column) -> Column:
        start, finish = state["at"], state["at"] + F.char_length(part)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), finish.alias("finish"), part.alias("found"))
        accepted = state["odd"] if keep is None else state["odd"] & keep(part)
        spans = F.when(accepted, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(finish.alias("at"), (~state["odd"]).alias("odd"), spans.alias("spans"))

    def of_block(parts: Column, before: Column) -> Column:
        return F.aggregate(parts, F.struct(before.alias("at"), F.lit(False).alias("odd"), empty.alias("spans")), step)["spans"]

    def located(parts: Column) -> Column:
        count = ((F.size(parts) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)))
        return _bound(blocks, lambda bs: _bound(F.transform(bs, length), lambda ns: joined(bs, ns)))

    def joined(blocks: Column, lengths: Column) -> Column:
        before = lambda b: F.aggregate(F.slice(lengths, F.lit(1), b), F.lit(0), lambda n, x: n + x)
        return F.flatten(F.transform(blocks, lambda parts, b: of_block(parts, before(b))))

    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    return _bound(parts, lambda ps: F.when(F.size(ps) > 1, located(ps)).otherwise(empty))


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of a window of a string over ``ALPHABET``; 0 if it is shorter than the window."""
    characters = F.filter(F.split(candidate, ""), lambda c: c != "")
    codes = F.transform(characters, lambda c: F.instr(F.lit(ALPHABET), c))
    size = len(ALPHABET) + 1
    # n * log2(n), the share of a character with n places in the window
    share = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])
    at = lambda n: F.element_at(share, n + F.lit(1))

    def slide(codes_: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            came = F.element_at(codes_, i)
            gone = F.when(i > window, F.element_at(codes_, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            before = F.element_at(state["counts"], came + 1)
            leaving = F.element_at(state["counts"], gone + 1)
            change = F.when(came == gone, F.lit(0.0)).otherwise(
                at(before + 1) - at(before) + F.when(gone > 0, at(leaving - 1) - at(leaving)).otherwise(F.lit(0.0))
            )
            total = state["total"] + change
            counts = F.transform(state["counts"], lambda n, j: n + (j == came).cast("int") - ((j == gone) & (gone > 0)).cast("int"))
            best = F.when(i >= window, F.greatest(state["best"], F.lit(math.log2(window)) - total / window)).otherwise(state["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"))

        start = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.size(codes_)), start, step)["best"]

    return _bound(codes, slide)


def _suspect(candidate: Column) -> Column:
    """If a candidate string has a window of high entropy for its class and is not allowed."""
    bare = F.rtrim(candidate, F.lit("="))
    threshold = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        threshold = F.when(bare.rlike(pattern), F.lit(bits)).otherwise(threshold)
    return ~candidate.rlike(ALLOWED) & (window_entropy(bare) >= threshold)


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (__row, __base, __spans): the rows of ``docs`` as structs, and sorted arrays of (start, rank, finish, found).

    ``__base`` has the matches of the fixed patterns (leftmost, non-overlapping within a kind; kinds may
    overlap), ``__spans`` also the entropy scan's, less those that overlap a base span. Null and empty
    texts have none; texts of any length are scanned whole. Offsets count code points, the end is
    exclusive. Repeated rows and null ids are rows like others.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    unmarked = F.when(F.contains(text, F.lit(_MARK)), F.replace(text, F.lit(_MARK), F.lit(_OTHER))).otherwise(text)
    t = F.col("__text")
    assigned = lambda found: F.char_length(F.regexp_extract(found, ASSIGN, 2)) >= MIN_ASSIGNED
    base = F.array_sort(F.concat(_spans(t, "assign", ASSIGN, assigned), _spans(t, "access", ACCESS), _spans(t, "hex", HEX)))
    added = packed(docs, __text=unmarked).withColumn("__base", base).withColumn("__added", _spans(t, "entropy", CANDIDATE, _suspect))
    new = F.filter("__added", lambda a: ~F.exists("__base", lambda b: (b["start"] < a["finish"]) & (a["start"] < b["finish"])))
    return added.select("__row", "__base", F.array_sort(F.concat("__base", new)).alias("__spans"))


def _listed(spans: str) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["finish"].cast("string"))), ",")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts of the base kinds, SHA-256 of the base spans, and all spans.

    Other columns are not read, whatever their names; an empty table gives no rows.
    """
    found = find_secrets(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    count = lambda kind: F.size(F.filter("__base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(
        F.col("__row.id").alias(id_col),
        *counts,
        F.sha2(_listed("__base"), 256).alias("base_sha256"),
        _listed("__spans").alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; overlapping spans become one.

    Null texts stay null. Columns of any name pass through; an empty table gives no rows.
    """
    text = F.col("__row").getField(text_col)

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        pieces = F.when(span["start"] >= state["at"], F.concat(state["pieces"], F.array(gap, F.lit(mask)))).otherwise(state["pieces"])
        return F.struct(F.greatest(state["at"], span["finish"]).alias("at"), pieces.alias("pieces"))

    def masked(done: Column) -> Column:
        return F.concat(F.array_join(done["pieces"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("pieces"))
    done = F.when(F.size("__spans") > 0, _bound(F.aggregate("__spans", start, step), masked)).otherwise(text)
    columns = [done if c == text_col else F.col("__row").getField(c) for c in docs.columns]
    return find_secrets(docs, text_col).select(*[x.alias(c) for x, c in zip(columns, docs.columns)])
