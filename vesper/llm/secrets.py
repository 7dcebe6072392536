"""Secret scan with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hexadecimal runs. Every candidate, among them bare
random-looking tokens without any context, is hashed, and the hashes are counted over the corpus by
distinct repositories and distinct owners. A value of one owner, in however many repositories, looks ``live``; one of
several owners is ``shared``, as in copied files; one of ``example_owners`` or more is a widely copied ``example``.
Bare tokens that look live are added as spans of kind ``owned``; shared ones and examples are not.
The values themselves never leave the scan; only their hashes do.

Defined results: a null or empty text has no spans. Null repositories or owners count as none, so
such a value has 0 owners and is not called an example. Repeated rows count once, as repositories
and owners are distinct. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._session import checkpointed, saved, ship

KINDS = ("assign", "access", "hex", "owned")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())])
FOUND = pa.struct([("base", pa.list_(SPAN)), ("bare", pa.list_(SPAN)), ("base_sha256", pa.string())])
FOUND_DDL = "struct<base:array<struct<kind:string,start:bigint,end:bigint,hash:bigint>>,bare:array<struct<kind:string,start:bigint,end:bigint,hash:bigint>>,base_sha256:string>"


def _hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value): whole matches by start and kind; the value of an assignment is its second group."""
    out = []
    low = text.lower() if text else ""
    if any(x in low for x in _ASSIGN_HINTS):
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _random_looking(value: str) -> bool:
    """Letters and several digits that alternate, as keys have and words, dates and rules don't."""
    digits = sum(c.isdigit() for c in value)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
    return digits >= 3 and digits < len(value) - 3 and turns >= 4 and len(set(value)) >= 8


def bare_spans(text: str, base: list) -> list[tuple[str, int, int, str]]:
    """Random-looking tokens that no base span (of those in order of their starts) overlaps."""
    out, at, farthest = [], 0, 0
    for m in _BARE.finditer(text):
        while at < len(base) and base[at][1] < m.end():
            farthest = max(farthest, base[at][2])
            at += 1
        if farthest <= m.start() and _random_looking(m[0]):
            out.append(("owned", *m.span(), m[0]))
    return out


def find(df: DataFrame, text: Column, output: str = "found") -> DataFrame:
    """Add a struct with the base spans, the bare candidates and the digest of the base spans."""
    from pyspark.sql.functions import arrow_udf

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for t in column.to_pylist():
                base = base_spans(t or "")
                bare = bare_spans(t or "", base)
                said = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in base)
                span = lambda x: {"kind": x[0], "start": x[1], "end": x[2], "hash": _hash(x[3])}
                out.append({"base": [*map(span, base)], "bare": [*map(span, bare)], "base_sha256": sha256(said.encode()).hexdigest()})
            yield pa.array(out, FOUND)

    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(output, arrow_udf(scan, FOUND_DDL)(text))


def ownership(candidates: DataFrame, hash_: str = "hash", repository: str = "repository", owner: str = "owner", *, example_owners: int = 5) -> DataFrame:
    """Per hash: occurrences, distinct repositories, distinct owners, and the verdict ``live``, ``shared`` or ``example``.

    Counting distinct values shuffles (hash, value) pairs that are already combined on the map side,
    so a value that a third of all rows hold is no more work for any task than another.
    """
    got = candidates.groupBy(hash_).agg(
        F.count("*").alias("occurrences"), F.count_distinct(repository).alias("repositories"), F.count_distinct(owner).alias("owners")
    )
    return got.withColumn("verdict", F.when(F.col("owners") >= example_owners, "example").when(F.col("owners") > 1, "shared").otherwise("live"))


def scan(df: DataFrame, text: Column, repository: Column, owner: Column, keep: list[Column], *, example_owners: int = 5) -> DataFrame:
    """The ``keep`` columns of every row, with base, base_sha256 and spans (base and live bare tokens, by start and kind).

    Spans have kind, start, end, repositories, owners and verdict. The text is read once; what is
    written and joined afterwards has spans and hashes only.
    """
    ship(df.sparkSession)
    named = df.select(F.struct(*keep).alias("kept"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text.alias("text"))
    found = find(named, F.col("text")).select("kept", "repository", "owner", "found").withColumn("rid", F.monotonically_increasing_id())
    found = checkpointed(found)
    each = found.select("rid", "repository", "owner", F.explode(F.concat("found.base", "found.bare")).alias("s")).select("rid", "repository", "owner", "s.*")
    # written first: a join of two plain exchanges can be split where one value stands in a third of all rows
    verdicts = saved(ownership(each, example_owners=example_owners), "verdicts")
    joined = each.join(verdicts, "hash").where((F.col("kind") != "owned") | (F.col("verdict") == "live"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = joined.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("rank"), "kind", "end", "repositories", "owners", "verdict"))).alias("spans"))
    out = found.join(spans, "rid", "left")
    return out.select("kept.*", F.col("found.base").alias("base"), F.col("found.base_sha256").alias("base_sha256"), F.coalesce("spans", F.expr("filter(array(named_struct('start', 0L, 'rank', 0, 'kind', '', 'end', 0L, 'repositories', 0L, 'owners', 0L, 'verdict', '')), x -> false)")).alias("spans"))
