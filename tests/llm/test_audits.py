"""License notices, divergence of sources and repair of conversations, against brute force and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import duckdb
import numpy as np
import pytest

from pathloom.llm import conversations, divergence, license_scan
from pathloom.llm.queries import OP12_SQL

from .conftest import prose
from .test_operators import clashing

# -- license notices ------------------------------------------------------------------------------------------------


def canonical(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def edit_distance_within(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def mistyped(words, edits, rng, keep):
    """``words`` with single-letter edits outside the words to be kept."""
    out = words.split(" ")
    free = [i for i, w in enumerate(out) if w not in keep and len(w) > 2]
    for i in rng.choice(free, edits, replace=False):
        at = int(rng.integers(1, len(out[i]) - 1))
        out[i] = {0: out[i][:at] + out[i][at + 1 :], 1: out[i][:at] + "q" + out[i][at:], 2: out[i][:at] + "q" + out[i][at + 1 :]}[int(rng.integers(3))]
    return " ".join(out)


def test_notices_within_their_edits_are_found():
    rng = np.random.default_rng(5)
    search = license_scan.NoticeSearch(license_scan.NOTICES)
    for seed, notice in enumerate(license_scan.NOTICES):
        for edits in range(notice.edits + 1):
            if edits > sum(w not in notice.exact and len(w) > 2 for w in notice.words.split(" ")):
                continue
            text = " ".join([*canonical(prose(seed, 30)), mistyped(notice.words, edits, rng, notice.exact), *canonical(prose(seed + 50, 30))])
            found = search.matches(text)
            assert notice.label in {license_scan.NOTICES[i].label for *_, i, _ in found}, (notice, edits)
            for a, b, i, n in found:
                assert n == edit_distance_within(license_scan.NOTICES[i].words, text[a:b]) <= license_scan.NOTICES[i].edits


def test_windows_miss_no_match():
    """Every place within the edits, by a full dynamic programme, has a window of its notice."""
    rng = np.random.default_rng(11)
    notices = license_scan.NOTICES[:4]
    search = license_scan.NoticeSearch(notices)
    for _ in range(120):
        notice = notices[int(rng.integers(4))]
        letters = list(notice.words)
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(len(letters)))
            letters[at : at + int(rng.integers(0, 2))] = list("zx"[: int(rng.integers(0, 2))])
        text = "kalo nes " + "".join(letters) + " tomi"
        windows = {i for i, *_ in search.windows(text)}
        for i, n in enumerate(notices):
            assert edit_distance_within(n.words, text) > n.edits or i in windows


def test_versions_and_neighbours_keep_their_own_label():
    search = license_scan.NoticeSearch(license_scan.NOTICES)
    labels = lambda t: {license_scan.NOTICES[i].label for *_, i, _ in search.matches(" ".join(canonical(t)))}
    assert labels("GNU General Public License, version 2") == {"gpl-2"}
    assert labels("the GNU General Public Licence, Version 3") == {"gpl-3"}
    assert labels("GNU Affero General Public License version 3") == {"agpl-3"}
    assert labels("Licensed under CC BY-SA 4.0") == {"cc-by-sa"} and labels("Licensed under CC-BY 4.0.") == {"cc-by"}
    assert labels("under the MPL license") == labels("the license of the bus under the bridge") == set()
    assert labels("x under the MIT license") == {"mit"}


def test_license_digests(odd_docs, no_docs, make_docs):
    texts = [
        "Intro é line.\n\nUnder   the MIT-License; more. under the mit license",
        "Licensed undr the Apache Licence, Versin 2.0.",
        "cc by nc CC-BY-NC cc by nd",
        prose(4, 200),
        None,
        "",
        "mit",
    ]
    rows = {r.doc_id: r for r in license_scan.license_digests(clashing(make_docs(texts))).collect()}
    for i, text in enumerate(texts, 1):
        words, r = canonical(text), rows[i]
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    assert rows[2].labels == "apache-2" and rows[2].n_base == 0 and rows[2].score < 1
    label, start, end, edits = rows[2].spans.split(":")
    assert texts[1][int(start) : int(end)] == "undr the Apache Licence, Versin 2" and int(edits) == 3
    spans = rows[1].spans.split(",")
    assert [texts[0][int(a) : int(b)] for _, a, b, _ in (s.split(":") for s in spans)] == ["Under   the MIT-License", "under the mit license"]
    assert rows[4].labels == rows[5].labels == "" and rows[4].score == 0
    assert license_scan.license_digests(clashing(odd_docs)).count() == odd_docs.count()
    assert license_scan.license_digests(no_docs).count() == 0


# -- divergence of sources -------------------------------------------------------------------------------------------


def checked(docs, monkeypatch=None):
    """Rows of the audit and of its SQL."""
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    want = connection.execute(OP12_SQL).fetchall()
    got = divergence.audit_sources(docs, min_documents=10, top=10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect())), sorted(want)


def test_sources_diverge_as_in_sql(spark, monkeypatch):
    """Sources with terms of their own, one that holds half of all rows, one without terms, a language without kept terms."""
    rows = []
    for i in range(150):
        source = "hot" if i % 2 else f"s{i % 5}"
        text = prose(i % 23, 40) + (" ownterm Ünï" if source == "s2" else "") + " The THE the"
        rows.append((i, text, "en" if i % 3 else "de", source))
    rows += [(200 + i, None if i else "...", "en", "empty") for i in range(3)] + [(300 + i, f"only{i} x1y", "fr", f"f{i}") for i in range(3)]
    rows += [(None, "the kalo", None, None), (7, "the kalo", None, "a"), (7, "the kalo", None, "a")] * 6
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    monkeypatch.setattr(divergence, "PORTION", 3000)
    monkeypatch.setattr(divergence, "SHARD_BYTES", 500)
    monkeypatch.setattr(divergence, "SHARD_CELLS", 20)
    got, want = checked(docs.repartition(3))
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert ("fr", "f0", "pair", "f1", 0, 1) in got and any(r[:2] == ("en", "empty") for r in got) and any(r[0] == "" for r in got)


def test_divergence_of_odd_rows(odd_docs, no_docs):
    got, want = checked(clashing(odd_docs))
    assert got == want
    assert divergence.audit_sources(no_docs).count() == 0


# -- repair of conversations ----------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def brute_audit(fields):
    """The cheapest edits, ties by the least string of initials, by search over (cost, audit)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heappop(heap)
        if at == len(fields) and state in ("", "a"):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in "ua":
            if (state, role) in step:
                heappush(heap, (cost + 3, audit + "I", at, step[state, role]))
        if at < len(fields):
            fault, initial = fields[at]
            heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (state, initial) in step:
                    heappush(heap, (cost + extra, audit + "K", at + 1, step[state, initial]))
                for role in "ua":
                    if (state, role) in step:
                        heappush(heap, (cost + 3 + extra, audit + "R", at + 1, step[state, role]))
    raise AssertionError


def brute_repairs(rows):
    """Expected rows by conversation, of (conv_id, turn, role, text)."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        own += [] if lot == 0 else [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, fields = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            fields.append((fault, role[:1]))
        turns = {t for t, *_ in own if t is not None}
        cost, audit = brute_audit(fields)
        repaired, at, state = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[at][1:]
            at += edit != "I"
            if edit in "IR":
                role = "assistant" if state == "u" else "user"
            if edit != "D":
                state = role[:1]
                repaired.append(f"{role}:{text}")
        faults = Counter(f for f, _ in fields)
        illegal = sum(a + b not in ("su", "ua", "au") for (_, a), (_, b) in zip(fields, fields[1:]))
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def test_layers_give_the_least_audit():
    rng = np.random.default_rng(2)
    kinds = {"": conversations.SOUND, "truncated": conversations.TRUNCATED_TURN, "duplicate": conversations.DUPLICATE, "blank": conversations.BLANK}
    for _ in range(4000):
        fields = [(str(rng.choice(list(kinds), p=[0.55, 0.2, 0.1, 0.15])), str(rng.choice(list("sua x"), p=[0.15, 0.35, 0.35, 0.1, 0.05]))) for _ in range(int(rng.integers(0, 9)))]
        assert conversations.least_audit([(kinds[f], i) for f, i in fields]) == brute_audit(fields)


def test_long_conversations_take_one_word_a_row():
    rows = [(conversations.SOUND, "sua"[i % 3]) for i in range(30_000)]
    cost, audit = conversations.least_audit(rows)
    assert cost > 3 * 9000 and len(audit) >= len(rows)


def conversation_rows():
    rng = np.random.default_rng(9)
    texts = ["Yes.", "No!", "  ", "", "cut off", "Wéll?\n", "...", None]
    roles = ["user", "assistant", "user", "assistant", "system", "", "tool", None]
    rows = []
    for conv in [*range(150), None]:
        for turn in range(int(rng.integers(1, 9))):
            known = rng.random() > 0.05
            normal = rng.random() > 0.25
            role = roles[turn % 2] if normal else roles[int(rng.integers(len(roles)))]
            text = f"Turn {turn} of it." if normal else texts[int(rng.integers(len(texts)))]
            rows.append((conv, turn * int(rng.integers(1, 3)) if known else None, role, text))
    return rows + rows[:40] + [(999, 0, "user", "x" * 300_000 + ".")] + [(1000, i, "user", "Same.") for i in range(2000)]


def test_conversations_are_repaired(spark):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "other", "other") for r in rows], "conv_id long, turn long, role string, text string, audit string, _place string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_digests(conversations.damaged(table.repartition(5))).collect()}
    assert got == brute_repairs(rows)


def test_repaired_turns_are_those_that_are_hashed(spark):
    turns = conversations.damaged(spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string"))
    kept = defaultdict(list)
    for r in conversations.repair_conversations(turns).orderBy("conv_id", "position").collect():
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.repair_digests(turns).collect()}
    assert set(kept) <= set(digests)
    assert digests == {c: hashlib.sha256("\n".join(kept[c]).encode()).hexdigest() for c in digests}


def test_conversations_without_rows(spark):
    """Of conversation ids whose only row is dropped, zeros remain; an empty table gives no rows."""
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    found = conversations.repair_digests(conversations.damaged(table)).collect()
    assert [tuple(r) for r in found] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_digests(conversations.damaged(table.where("false"))).count() == 0


@pytest.mark.parametrize("initials,want", [("", (0, "")), ("s", (4, "D")), ("a", (3, "IK")), ("u", (3, "KI")), ("sua", (0, "KKK")), ("aua", (3, "IKKK"))])
def test_small_repairs(initials, want):
    assert conversations.least_audit([(conversations.SOUND, i) for i in initials]) == want
