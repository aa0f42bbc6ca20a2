"""SQL of the draws in ``operators.draws``: each function gives CTEs to stand behind others, from one table to another."""

from __future__ import annotations

from pathloom.operators.draws import below_sql, uniform_sql


def _listed(by: tuple[str, ...], end: str = ", ") -> str:
    return "".join(f"{c}{end}" for c in by)


def numbered(source: str, out: str, by: tuple[str, ...], *key: str) -> str:
    """``out``: ``source`` with numbers i from 0 within ``by`` in the order of the key's digest, and their number n."""
    text = f"concat_ws(':', {', '.join(key)})"
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f""", {out} AS (
        SELECT *, row_number() OVER ({part}ORDER BY md5({text}), {text}) - 1 AS i, count(*) OVER ({part}) AS n
        FROM {source}
    )"""


def picks(source: str, out: str, by: tuple[str, ...], repeats: int, seed: int, *key: str) -> str:
    """``out`` (by, draw, slot, i): draws with replacement from the numbered rows ``out``_placed."""
    pick = below_sql("n", str(seed), *by, "draw", "i")
    return numbered(source, f"{out}_placed", by, *key) + f""", {out} AS (
        SELECT {_listed(by)}draw, i AS slot, n, {pick} AS i FROM {out}_placed, range({repeats}) d(draw)
    )"""


def means(source: str, out: str, by: tuple[str, ...], value: str, repeats: int, seed: int) -> str:
    """``out`` (by, draw, m): means of resamples of the texts' values."""
    on = " AND ".join([f"p.{c} = d.{c}" for c in by] + ["p.i = d.i"])
    own = _listed(tuple(f"d.{c}" for c in by))
    return picks(source, f"{out}_picks", by, repeats, seed, "text_id") + f""", {out} AS (
        SELECT {own}draw, avg({value}) AS m FROM {out}_picks d JOIN {out}_picks_placed p ON {on} GROUP BY {own}draw
    )"""


def interval(source: str, out: str, by: tuple[str, ...], value: str, repeats: int, seed: int, flips: bool = False) -> str:
    """``out`` (by, n, mean, low, high, p) of a table with texts' values, none of them null."""
    keys = ", ".join(by)
    sql = means(source, f"{out}_means", by, value, repeats, seed) + f""", {out}_limits AS (
        SELECT {keys}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM {out}_means GROUP BY {keys}
    ), {out}_seen AS (SELECT {keys}, count(*) AS n, avg({value}) AS mean FROM {source} GROUP BY {keys})"""
    if not flips:
        return sql + f", {out} AS (SELECT *, NULL AS p FROM {out}_seen JOIN {out}_limits USING ({keys}))"
    sign = uniform_sql("'flip'", str(seed), *by, "draw", "text_id")
    return sql + f""", {out}_flipped AS (
        SELECT {keys}, draw, avg(CASE WHEN {sign} % 2 = 0 THEN {value} ELSE -{value} END) AS m
        FROM {source}, range({repeats}) d(draw)
        GROUP BY {keys}, draw
    ), {out}_beyond AS (
        SELECT {keys}, (1 + count(*) FILTER (WHERE abs(m) >= abs(mean) - 1e-12)) / {repeats + 1}.0 AS p
        FROM {out}_flipped JOIN {out}_seen USING ({keys})
        GROUP BY {keys}
    ), {out} AS (SELECT * FROM {out}_seen JOIN {out}_limits USING ({keys}) JOIN {out}_beyond USING ({keys}))"""


def split_half(repeats: int, seed: int, corr: str) -> str:
    """From transitions ``tr`` and ``edges``: ``e`` (draw, text_id, r) of halves, and ``sizes`` (text_id, n subjects). ``corr`` reads ``v``."""
    return (
        f""", drawn AS (SELECT * FROM (SELECT DISTINCT text_id, subject_id FROM tr), range({repeats}) d(draw))"""
        + numbered("drawn", "dealt", ("text_id", "draw"), str(seed), "draw", "text_id", "subject_id")
        + """, dr AS (SELECT text_id, subject_id, draw, CASE WHEN i < n // 2 THEN 0 ELSE 1 END AS half FROM dealt
    ), sizes AS (SELECT text_id, count(*) AS n FROM (SELECT DISTINCT text_id, subject_id FROM tr) GROUP BY text_id
    ), h AS (SELECT draw, half, text_id, src_word, dst_word, sum(n) AS c FROM edges JOIN dr USING (text_id, subject_id) GROUP BY ALL
    ), p AS (SELECT *, c / sum(c) OVER (PARTITION BY draw, half, text_id, src_word) AS p FROM h
    ), w AS (SELECT text_id, max(greatest(src_word, dst_word)) + 1 AS w FROM tr GROUP BY ALL
    ), ok AS (SELECT draw, text_id, src_word FROM p GROUP BY ALL HAVING count(DISTINCT half) = 2
    ), grid AS (SELECT ok.*, unnest(range(w)) AS dst_word FROM ok JOIN w USING (text_id)
    ), v AS (
        SELECT g.draw, g.text_id, coalesce(max(p) FILTER (WHERE half = 0), 0) AS x, coalesce(max(p) FILTER (WHERE half = 1), 0) AS y
        FROM grid g LEFT JOIN p USING (draw, text_id, src_word, dst_word)
        GROUP BY g.draw, g.text_id, g.src_word, g.dst_word
    ), e AS ("""
        + corr
        + ")"
    )


def logistic(source: str, out: str, rounds: int = 12) -> str:
    """``out`` (k, a, c): penalised slope and free intercept of each ``k`` of a table (k, z, y), by Newton steps."""
    sql = f", l0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM {source})"
    for i in range(rounds):
        sql += f"""
    , s{i} AS (
        SELECT k, any_value(a) AS a, any_value(c) AS c, any_value(a) + sum(z * (q - y)) AS ga, sum(q - y) AS gc,
               1 + 1e-10 + sum(z * z * q * (1 - q)) AS haa, sum(z * q * (1 - q)) AS hac, 1e-10 + sum(q * (1 - q)) AS hcc
        FROM (SELECT *, 1 / (1 + exp(-(a * z + c))) AS q FROM {source} JOIN l{i} USING (k))
        GROUP BY k
    ), l{i + 1} AS (
        SELECT k, a - (ga * hcc - gc * hac) / (haa * hcc - hac * hac) AS a, c - (haa * gc - hac * ga) / (haa * hcc - hac * hac) AS c FROM s{i}
    )"""
    return sql + f", {out} AS (SELECT * FROM l{rounds})"
