"""Audits of a release: what is reached from its entry points, what lies outside the allowed paths, what must not be in it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.sources.scratch import written

# What a released file must not hold, and its largest size in bytes.
SECRETS = {
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "GitHub token": r"gh[pousr]_[A-Za-z0-9]{30,}",
    "AWS access key": r"AKIA[0-9A-Z]{16}",
    "assigned secret": r"""(?i)(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\s*[:=]\s*['"][^'"\s]{8,}['"]""",
}
MAX_BYTES = 10 * 1024 * 1024


def compile_globs(globs: list[str]) -> str:
    """One pattern of whole paths for a list of globs: ``*`` and ``?`` stay within a folder, ``**`` goes through any.

    Blank lines and comments are left out; absolute paths, backslashes and ``..`` raise.
    """
    kept = [g.strip() for g in globs if g.strip() and not g.strip().startswith("#")]
    for g in kept:
        if g.startswith("/") or ".." in g.split("/") or "\\" in g:
            raise ValueError(f"unsafe path {g!r}")
    special = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = ["".join(special.get(token) or re.escape(token) for token in re.split(r"(\*\*/|\*\*|\*|\?)", g)) for g in kept]
    return f"^(?:{'|'.join(parts)})$" if parts else r"^\b$"


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): all nodes of ``edges`` (source, target) that ``roots`` (node) reach, and the fewest steps to each.

    Semi-naive: a round follows the edges of the nodes that the last one found and takes what no round had found, so
    every edge is followed once and cycles end. Rounds are as many as the longest of the shortest ways. Nulls are no nodes.
    """
    links = written(edges.select("source", "target").where("source is not null and target is not null").distinct(), "edges")
    delta = written(roots.select("node").where("node is not null").distinct(), "reached")
    found, depth = delta.withColumn("depth", F.lit(0)), 0
    while not delta.isEmpty():
        depth += 1
        ahead = delta.join(links, delta["node"] == links["source"]).select(F.col("target").alias("node")).distinct()
        delta = written(ahead.join(found.select("node"), "node", "left_anti"), "reached")
        found = found.unionByName(delta.withColumn("depth", F.lit(depth)))
    return found


def broken_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` (source, target) whose target is none of ``nodes`` (node)."""
    return links.join(nodes.select(F.col("node").alias("target")).distinct(), "target", "left_anti").select("source", "target")


def findings(files: DataFrame, allowed: list[str], required: list[str] = (), secrets: dict[str, str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, finding): files (path, content) outside the allowed globs, too large, or with a secret; required ones that are not there.

    All rules are columns of one pass; null content is empty.
    """
    secrets = SECRETS if secrets is None else secrets
    content = F.coalesce(F.col("content"), F.lit(""))
    rules: dict[str, Column] = {"not declared public": ~F.col("path").rlike(compile_globs(allowed)), "too large": F.octet_length(content) > max_bytes}
    rules |= {f"possible {name}": content.rlike(pattern) for name, pattern in secrets.items()}
    marked = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    found = files.select("path", F.explode(marked).alias("finding"))
    wanted = files.sparkSession.createDataFrame([(p,) for p in required], "path string")
    missing = wanted.join(files.select("path"), "path", "left_anti").withColumn("finding", F.lit("required file is missing"))
    return found.unionByName(missing)
