"""Repair of conversations whose turns are damaged, at the least cost.

A conversation is sound if the initials of its roles spell ``(s?(ua)+)?``; the automaton has four states (nothing yet,
after a system turn, after a user's, after an assistant's). Going from the last row to the first, every row has one
word of bits: layer c, four bits wide, is the set of states from which the rest can be brought to an end at cost c.
An edit moves a set by one step of the grammar and up by its cost in layers, so a row costs a few shifts whatever its
length. The lowest layer that holds the first state is the least cost; bits tell, row by row, which edits lie on a
cheapest way, and the one with the least initial is taken.

Layers are kept relative to a row's cheapest state. From every state each other is within 10 of it (at most two
inserted turns and a deleted one), so 16 layers hold all that a cheapest way can pass, whatever the cost.

The rows of a conversation stream through one task: their fields without texts for the audit, then their texts for the
repaired turns, whose digest is one hash over all of them in order. What is held is a word and a byte for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, releasing

# The costs of edits and of a truncated turn that stays; roles that an edit can give.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = ("user", "assistant")

_LAYERS = 16
_ALL = (1 << 4 * _LAYERS) - 1
_EACH = int("1" * _LAYERS, 16)
#: States as bits: nothing yet, after a system turn, after a user's, after an assistant's.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = 1, 2, 4, 8
_NEXT = {
    ("u", _NOTHING): _USER,
    ("u", _SYSTEM): _USER,
    ("u", _ASSISTANT): _USER,
    ("a", _USER): _ASSISTANT,
    ("s", _NOTHING): _SYSTEM,
}
#: Kinds of rows.
SOUND, TRUNCATED_TURN, DUPLICATE, BLANK, DROPPED = range(5)

AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _before_user(x: int) -> int:
    """States from which a user's turn leads into a set, in all layers at once."""
    y = (x >> 2) & _EACH
    return y | y << 1 | y << 3


def _before_assistant(x: int) -> int:
    return ((x >> 3) & _EACH) << 2


def _before_system(x: int) -> int:
    return (x >> 1) & _EACH


_BEFORE = {"u": _before_user, "a": _before_assistant, "s": _before_system}


def _with_inserts(x: int) -> int:
    """A set with the states that reach it by inserted turns; after two, further ones only come back."""
    for _ in range(2):
        x |= (_before_user(x) | _before_assistant(x)) << 4 * INSERT
    return x & _ALL


def cost_layers(rows: list[tuple[int, str]]) -> tuple[list[int], list[int]]:
    """For each row of (kind, initial), and the end, the layers of states and the cost of the lowest of them."""
    word, base = _with_inserts(_NOTHING | _ASSISTANT), 0
    words, bases = [word], [base]
    for kind, initial in reversed(rows):
        before = word << 4 * DELETE
        if kind in (SOUND, TRUNCATED_TURN):
            extra = 4 * TRUNCATED if kind == TRUNCATED_TURN else 0
            if initial in _BEFORE:
                before |= _BEFORE[initial](word) << extra
            before |= (_before_user(word) | _before_assistant(word)) << 4 * REROLE + extra
        low = ((before & -before).bit_length() - 1) // 4
        base += low
        word = _with_inserts(before >> 4 * low)
        words.append(word)
        bases.append(base)
    return words[::-1], bases[::-1]


def least_audit(rows: list[tuple[int, str]]) -> tuple[int, str]:
    """The least cost of a repair, and of the cheapest repairs the initials of edits (D, I, K, R) that come first in ASCII.

    Each initial leads on from a state to one state only, so the way is found without trying.
    """
    words, bases = cost_layers(rows)

    def open_(i: int, state: int | None, cost: int) -> bool:
        layer = cost - bases[i]
        return state is not None and 0 <= layer < _LAYERS and bool(words[i] >> 4 * layer & state)

    at, state = 0, _NOTHING
    rest = next(bases[0] + c for c in range(_LAYERS) if words[0] >> 4 * c & _NOTHING)
    cost, audit = rest, []
    while at < len(rows) or rest:
        inserted = _NEXT.get(("u", state)) or _NEXT.get(("a", state))
        if at < len(rows):
            kind, initial = rows[at]
            if open_(at + 1, state, rest - DELETE):
                audit.append("D")
                at, rest = at + 1, rest - DELETE
                continue
        if open_(at, inserted, rest - INSERT):
            audit.append("I")
            state, rest = inserted, rest - INSERT
            continue
        extra = TRUNCATED if kind == TRUNCATED_TURN else 0
        kept = _NEXT.get((initial, state))
        if open_(at + 1, kept, rest - extra):
            audit.append("K")
            state, rest = kept, rest - extra
        else:
            audit.append("R")
            state, rest = inserted, rest - extra - REROLE
        at += 1
    return cost, "".join(audit)


def _fields(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text, dropped) with nulls as one space, a digest of the text, and its own faults."""
    space = r"[\x20\x09-\x0D]"
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    bare = F.regexp_replace("text", f"{space}+$", "")
    own = F.when(F.col("dropped"), DROPPED).when(F.regexp_replace("text", space, "") == "", BLANK)
    ended = F.substring(bare, -1, 1).isin(".", "!", "?")
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.unhex(F.md5("text")).alias("digest"),
        own.when(ended, SOUND).otherwise(TRUNCATED_TURN).alias("kind"),
    )


def _streams(batches: Iterator[pa.RecordBatch], head: str | None = None) -> Iterator[tuple]:
    """(conv_id, its rows as tuples of the other columns, lazily) for each run of equal ids; a run is taken up to its end."""

    def rows():
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield from zip(*columns)

    stream = rows()
    row = next(stream, None)

    while row is not None:
        key = row[0]

        def run():
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(stream, None)

        of_key = run()
        yield key, of_key
        for _ in of_key:
            pass


def audit_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of (conv_id, turn, role, text, dropped).

    Rows go by turn (nulls first), then role, then a digest of the text; dropped ones name their conversation only. A
    row's first fault counts: blank, a duplicate of an earlier row's role and text (by a digest of 128 bits), truncated.
    ``gaps`` are the numbers between turns that are not there, ``illegal`` the adjacent initials other than su, ua, au.
    Rows without an id are one conversation; a conversation without rows has zeros and no edits.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    seen = Window.partitionBy("conv_id", "role", "digest", F.col("kind") == DROPPED).orderBy(F.asc_nulls_first("turn"))
    rows = _fields(turns).drop("text").withColumn("earlier", F.row_number().over(seen) > 1)
    faults = F.when(F.col("kind").isin(SOUND, TRUNCATED_TURN) & F.col("earlier"), DUPLICATE).otherwise(F.col("kind"))
    narrow = rows.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), faults.alias("kind"), "role", "digest", "earlier")
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "earlier")

    def run(batches):
        held = []
        for key, rows in _streams(batches):
            held.append((key, *_audited((turn, kind, initial) for turn, initial, kind in rows)))
            if len(held) >= 1024:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    schema = f"conv_id {kind}, {AUDIT}"
    id_type = dealt.select("conv_id").limit(0).toArrow().schema[0].type
    names = ["conv_id", *[c.split()[0] for c in AUDIT.split(", ")]]
    types = [id_type, *[pa.int64()] * 6, pa.string()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return dealt.select("conv_id", "turn", "initial", "kind").mapInArrow(releasing(run), schema)


def _audited(rows: Iterator[tuple]) -> tuple[int, int, int, int, int, int, str]:
    counts, illegal, last, fields = [0] * 5, 0, None, []
    low = high = None
    turns = 0
    for turn, kind, initial in rows:
        if kind == DROPPED:
            continue
        counts[kind] += 1
        if turn is not None:
            turns += turn != high
            low, high = turn if low is None else low, turn
        illegal += last is not None and last + initial not in ("su", "ua", "au")
        last = initial
        fields.append((kind, initial))
    cost, audit = least_audit(fields)
    gaps = 0 if low is None else high - low + 1 - turns
    return gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED_TURN], illegal, cost, audit


def _repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves of (role, text) rows."""
    state = _NOTHING
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _NEXT[role[:1], state]
        else:
            given = 0 if ("u", state) in _NEXT else 1
            role, state = ROLES[given], _NEXT[ROLES[given][0], state]
        yield edit, role, text


def _with_audits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one partition."""
    bounded_batches(turns)
    texts = _fields(turns).where(F.col("kind") != DROPPED).select("conv_id", F.lit(1).alias("_place"), "turn", "role", "digest", "text")
    audit = F.to_json(F.struct(*[c.split()[0] for c in AUDIT.split(", ")]))
    heads = audits.select("conv_id", F.lit(0).alias("_place"), F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit(None).cast("binary").alias("digest"), audit.alias("text"))
    together = heads.unionByName(texts).repartition("conv_id")
    return together.sortWithinPartitions("conv_id", "_place", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "_place", "role", "text")


def repair_conversations(turns: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of each conversation after its cheapest repair, positions from 0.

    ``turns`` has (conv_id, turn, role, text, dropped); kept, rerolled and inserted turns have edit K, R and I.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = _with_audits(turns, audit_conversations(turns) if audits is None else audits)
    id_type = dealt.select("conv_id").limit(0).toArrow().schema[0].type
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches):
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
        for key, rows in _streams(batches):
            _, audit, _ = next(rows)
            for position, (edit, role, text) in enumerate(_repaired(audit, ((r, t) for _, r, t in rows))):
                held.append((key, position, edit, role, text))
                size += len(text)
                if len(held) >= 2000 or size > 4 << 20:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return dealt.mapInArrow(releasing(run), f"conv_id {kind}, position long, edit string, role string, text string")


def repair_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation: its audit and the SHA-256 of the repaired ``role:text``, joined by newlines.

    Turns are hashed as they stream by, and never held together.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = _with_audits(turns, audit_conversations(turns))
    id_type = dealt.select("conv_id").limit(0).toArrow().schema[0].type

    def run(batches):
        held = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (id_type, pa.string(), pa.string()))], ["conv_id", "found", "repaired_sha256"])
        for key, rows in _streams(batches):
            _, audit, found = next(rows)
            digest = hashlib.sha256()
            for position, (_, role, text) in enumerate(_repaired(audit, ((r, t) for _, r, t in rows))):
                digest.update((("\n" if position else "") + f"{role}:{text}").encode())
            held.append((key, found, digest.hexdigest()))
            if len(held) >= 1024:
                yield batch()
                held = []
        if held:
            yield batch()

    digests = dealt.mapInArrow(releasing(run), f"conv_id {kind}, found string, repaired_sha256 string")
    audited = digests.select("conv_id", F.from_json("found", AUDIT).alias("found"), "repaired_sha256")
    return audited.select("conv_id", "found.*", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as the audit's trial wants them: (conv_id, turn, role, text, dropped).

    A checksum of ``conv_id:turn`` drops a row, empties its text, takes away its sentence marks, repeats it, or gives
    it to the user; others stay. Nulls are one space, but for an id's and a turn's own. Other columns are not read.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(lot == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        (lot == 0).alias("dropped"),
        F.when(lot == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")
