"""URL filters: host and path rules, and exact set membership by Bloom filter cascades.

A cascade is built for the listed keys against the complete universe of keys:
level 0 encodes the listed keys, level 1 the unlisted ones that level 0 lets
through, level 2 the listed ones that level 1 lets through, and so on until no
false positive is left. For keys of the universe its answer is exact.

Keys are dealt by hash into shards of about ``SHARD_KEYS``; each shard's cascade
is built by one task. Cascades are sent to the tasks only while they are under
``SENT_BYTES`` together; beyond, they go in several rounds, each judging the
keys of its own shards, so no round is larger, and no join of the pages is needed.

Defined results: a null url, or one without ``://``, has an empty host and path
and takes part as the host ''. Repeated pages are judged each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SHARD_KEYS = 20_000
SENT_BYTES = 64 << 20
BITS_PER_KEY = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ``://`` up to / ? # or the end, A-Z lower-cased; path: on from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule (host + path) and verdict of the longest of ``rules(verdict, host, path)`` that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _hashes(keys: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=16).digest() for k in keys), dtype="<u8").reshape(-1, 2)


def _places(hashes: np.ndarray, level: int, size: int, probes: int = 3) -> np.ndarray:
    first, step = hashes[:, 0] + np.uint64(level) * hashes[:, 1], (hashes[:, 1] >> np.uint64(7)) | np.uint64(1)
    scrambled = [(first + np.uint64(i) * step) * np.uint64(0x9E3779B97F4A7C15) for i in range(1, probes + 1)]
    return np.stack([((s >> np.uint64(29)) % np.uint64(size)).astype(np.int64) for s in scrambled], axis=1)


def cascade(listed: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (one byte a bit) of the levels for hashed keys."""
    levels: list[np.ndarray] = []
    inside, outside = listed, others
    while len(inside):
        bits = np.zeros(max(8, BITS_PER_KEY * len(inside)), dtype=np.uint8)
        bits[_places(inside, len(levels), len(bits))] = 1
        levels.append(bits)
        inside, outside = outside[bits[_places(outside, len(levels) - 1, len(bits))].all(axis=1)] if len(outside) else outside, inside
        if len(levels) > 200:
            raise ValueError("a key is both listed and not")
    return levels


def listed_by(levels: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: it is when the first level that does not hold it is an odd one, or the last one is even."""
    answer = np.full(len(hashes), len(levels) % 2 == 1)
    left = np.arange(len(hashes))
    for level, bits in enumerate(levels):
        if not len(left):
            break
        held = bits[_places(hashes[left], level, len(bits))].all(axis=1)
        answer[left[~held]] = level % 2 == 1
        left = left[held]
    return answer


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def build(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """shard, level, n_bits, bits of the cascades over ``universe(key, listed)``, and the number of shards.

    A null key is left out; a key that is listed in any row is listed.
    """
    keys = cut_lineage(universe.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    shards = keys.count() // shard_keys + 1

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, listed = _hashes(pdf["key"].tolist()), pdf["listed"].to_numpy(dtype=bool)
        levels = cascade(hashes[listed], hashes[~listed])
        rows = [(pdf["shard"].iloc[0], i, len(b), np.packbits(b).tobytes()) for i, b in enumerate(levels)]
        return pd.DataFrame(rows, columns=["shard", "level", "n_bits", "bits"])

    built = keys.withColumn("shard", _shard(F.col("key"), shards)).groupBy("shard").applyInPandas(one, "shard int, level int, n_bits int, bits binary")
    return cut_lineage(built, "cascades"), shards


def mark(rows: DataFrame, key: str, cascades: DataFrame, shards: int, into: str = "listed", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``rows`` with the membership of their key; a null key is not listed."""
    sizes = cascades.groupBy("shard").agg(F.sum("n_bits").alias("n")).orderBy("shard").toLocalIterator()
    rounds: list[list[int]] = [[]]
    held = 0
    for r in sizes:
        if held + r["n"] > sent_bytes and rounds[-1]:
            rounds.append([])
            held = 0
        rounds[-1].append(r["shard"])
        held += r["n"]
    names = [f"`{c}`" for c in rows.columns if c != into]
    dealt = rows.withColumn("__shard", F.coalesce(_shard(F.col(key), shards), F.lit(0)))
    out = None
    for i, group in enumerate(rounds):
        low = -1 if i == 0 else group[0] - 1
        high = shards if i + 1 == len(rounds) else rounds[i + 1][0] - 1
        part = dealt if len(rounds) == 1 else dealt.filter((F.col("__shard") > low) & (F.col("__shard") <= high))
        table = {}
        for r in cascades.filter(F.col("shard").isin(group)).collect() if group else []:
            table.setdefault(r["shard"], []).append((r["level"], r["n_bits"], bytes(r["bits"])))
        judged = part.withColumn(into, _member(rows.sparkSession.sparkContext.broadcast(table))(F.col(key), F.col("__shard"))).select(*names, into)
        out = judged if out is None else out.unionByName(judged)
    return out


def _member(shared):
    @F.pandas_udf("boolean")
    def member(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        levels = {s: [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n) for _, n, b in sorted(v)] for s, v in shared.value.items()}
        for keys, shards in batches:
            answer = np.zeros(len(keys), dtype=bool)
            known, at = np.unique(keys.fillna("").to_numpy(dtype=str), return_inverse=True) if len(keys) else ([], [])
            if len(keys):
                shard_of = np.zeros(len(known), dtype=np.int64)
                shard_of[at] = shards.to_numpy()
                hashes = _hashes(list(known))
                inside = np.zeros(len(known), dtype=bool)
                for shard in np.unique(shard_of):
                    if shard in levels:
                        rows = np.flatnonzero(shard_of == shard)
                        inside[rows] = listed_by(levels[shard], hashes[rows])
                answer = inside[at] & keys.notna().to_numpy()
            yield pd.Series(answer)

    return member


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: Column) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages(page_id, url)``.

    ``listed`` is an expression of the column ``host`` that tells which hosts of
    the corpus are on the block list; pages without a rule follow the list.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    cascades, shards = build(parsed.select(F.col("host").alias("key"), F.coalesce(listed, F.lit(False)).alias("listed")))
    marked = mark(parsed, "host", cascades, shards)
    rule, said = rule_verdict(F.col("host"), F.col("path"), rules)
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
