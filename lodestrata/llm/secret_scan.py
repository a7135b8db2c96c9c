"""Secret scans by corpus-wide ownership frequency.

Candidates are found in each whole text: the base kinds (assign, access, hex) and further kinds of
token. The values' hashes are aggregated over the corpus by distinct repositories and distinct owners. A value
of several owners, or of more than LIVE_REPOS repositories of one owner (a template's), is a widely copied
example; another value that looks random is taken for live.
Base spans are always reported; a span of a further kind only if its value is live and it doesn't lie in a
base span. Each document also gets its counts of live and of example values.

Counting is two-level (per value and owner, then per value), so a value that is copied into a third of all
documents is pre-aggregated where it is read. Values on a HEAVY-th of all candidates or more, at most HEAVY of them,
meet their candidates by a broadcast; the others shuffle.

Defined results: null and empty texts have no spans; a null owner or repository counts as one of its own; repeated
rows get repeated results and count once per repository; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, stored, text_of

#: Base kinds, in order, with the least length that passes and the group it is measured on.
BASE = {
    "assign": (re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 12, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    # A maximal run that is too short never hides a longer one, so the length can be in the pattern.
    "hex": (re.compile(r"[0-9a-f]{16,}"), 16, 0),
}
#: Further kinds, public token shapes.
FURTHER = {
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "forge": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "service": re.compile(r"\b[sr]k[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20,}"),
    "maps": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
}
KINDS = (*BASE, *FURTHER)
#: Bits a character at least, owners and repositories at most, of a live value.
LIVE_ENTROPY = 3.0
LIVE_OWNERS, LIVE_REPOS = 1, 20
#: Values that a HEAVY-th of all candidates hold are joined by a broadcast.
HEAVY = 1024


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, str, int, str]]:
    """start, kind, end, value of the base kinds, by start, then kind as listed."""
    out = []
    for rank, (kind, (pattern, least, group)) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((m.start(), rank, kind, m.end(), m[group]))
    out.sort()
    return [(start, kind, end, value) for start, _, kind, end, value in out]


def further_spans(text: str, base: list[tuple[int, str, int, str]]) -> list[tuple[int, str, int, str]]:
    out = []
    for kind, pattern in FURTHER.items():
        for m in pattern.finditer(text):
            if not any(a <= m.start() and m.end() <= b for a, _, b, _ in base):
                out.append((m.start(), kind, m.end(), m[0]))
    return out


def joined(spans: list[tuple[int, str, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end, _ in spans)


def candidates(docs: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """Stored scan: row, doc_id, repo, owner, base counts and digest, and found: array of (value hash, kind, start, end, random, base)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    span = "struct<value:binary,kind:string,start:bigint,end:bigint,random:boolean,base:boolean>"
    schema = f"doc_id {doc_type}, repo string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<{span}>"
    found_type = pa.list_(pa.struct([("value", pa.binary()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("random", pa.bool_()), ("base", pa.bool_())]))

    def entry(x: tuple[int, str, int, str], base: bool) -> dict:
        start, kind, end, value = x
        return {"value": hashlib.sha256(value.encode()).digest(), "kind": kind, "start": start, "end": end, "random": kind == "pem" or entropy(value) >= LIVE_ENTROPY, "base": base}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, digests, found = [], [], []
            for text in text_of(part).to_pylist():
                base = base_spans(text)
                n = Counter(x[1] for x in base)
                counts.append([n[k] for k in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                found.append([entry(x, True) for x in base] + [entry(x, False) for x in further_spans(text, base)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(found, found_type)],
                ["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    plain = docs.select("doc_id", "text", F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    return stored(in_arrow(plain, run, schema).withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """value, repos, owners, n: distinct repositories and owners of each value, nulls as one each, and its candidates."""
    each = found.select(F.explode("found.value").alias("value"), "repo", "owner").groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    per_owner = each.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return per_owner.groupBy("value").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))


def with_owners(exploded: DataFrame, owners: DataFrame) -> DataFrame:
    """Candidates with their value's repos and owners; a value that many hold doesn't shuffle."""
    least = (owners.agg(F.sum("n").alias("n")).first()["n"] or 0) / HEAVY
    heavy = owners.where(F.col("n") >= least).drop("n")
    light = exploded.join(F.broadcast(heavy.select("value")), "value", "left_anti").join(owners.where(F.col("n") < least).drop("n"), "value")
    return exploded.join(F.broadcast(heavy), "value").unionByName(light)


def scan_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for every document."""
    scanned = candidates(docs, repo_col, owner_col)
    owners = stored(ownership(scanned), "owners")
    plain = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    exploded = scanned.where(F.size("found") > 0).select("row", *plain, F.explode("found").alias("x")).select("row", *plain, "x.*")
    copied = (F.col("owners") > live_owners) | (F.col("repos") > live_repos)
    judged = with_owners(exploded, owners).withColumn("example", copied).withColumn("live", F.col("random") & ~copied)
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    shown = F.when(F.col("base") | F.col("live"), F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("span")))
    per_row = judged.groupBy("row", *plain).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["span"]), ",").alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    quiet = scanned.where(F.size("found") == 0).select(*plain, F.lit("").alias("spans"), F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_example"))
    return quiet.unionByName(per_row.drop("row"))
