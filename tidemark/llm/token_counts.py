"""Edit-aware token counts with segment trees over the words of each document.

A document is cut into leaves of about ``LEAF`` characters, only in front of a
blank between two other characters, where no word of the vocabulary's
pre-tokenizer begins earlier or ends later. The tree keeps characters and
tokens per node. An edit finds its leaves by descending the character sums,
takes in the next leaf where it touches the two characters around a cut, re-encodes
that region alone, and adds the difference to the sums on the way up.

Trees are small rows (two integers a leaf and their sums) that can be written and
joined back by key, so a later edit of a corpus re-encodes a small part of it.

Defined results: null and empty texts have one empty leaf and no tokens.
Edits are ``struct<start,stop,replacement>`` in code points of the original
text, without overlaps; a null array is no edit; edits out of range are cut to
the text. Rows are joined by doc_id and a hash of the text, nulls included, so
repeated rows stay apart from other texts of the same key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm import tokenizing

LEAF = 512
_CUT = re.compile(r"(?<=\S) (?=\S)")


def leaves(text: str, leaf: int = LEAF) -> list[int]:
    """Start of each leaf."""
    starts, at = [0], leaf
    while at < len(text):
        found = _CUT.search(text, at)
        if not found:
            break
        starts.append(found.start())
        at = found.start() + leaf
    return starts


class Tree:
    """Sums of characters and tokens, as complete binary heaps: node 1 is the root, the leaves are the last row."""

    def __init__(self, sums: np.ndarray):
        self.sums = sums
        self.base = sums.shape[1] // 2

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> Tree:
        base = 1 << max(0, len(chars) - 1).bit_length()
        sums = np.zeros((2, 2 * base), dtype=np.int64)
        sums[0, base : base + len(chars)] = chars
        sums[1, base : base + len(tokens)] = tokens
        level = base
        while level > 1:
            half = level // 2
            sums[:, half:level] = sums[:, level : 2 * level : 2] + sums[:, level + 1 : 2 * level : 2]
            level = half
        return cls(sums)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character and where it starts; the last one for a place at or beyond the end."""
        place = max(0, min(place, int(self.sums[0, 1]) - 1))
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if place >= start + self.sums[0, node]:
                start += int(self.sums[0, node])
                node += 1
        return node - self.base, start

    def chars(self, leaf: int) -> int:
        return int(self.sums[0, self.base + leaf])

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.base + leaf
        more = np.array([chars, tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += more
            node //= 2


def grow(text: str | None, one: tokenizing.Encoder, leaf: int = LEAF) -> Tree:
    text = text or ""
    starts = leaves(text, leaf)
    ends = [*starts[1:], len(text)]
    return Tree.of([e - s for s, e in zip(starts, ends, strict=True)], [len(one.ids(text[s:e])) // 4 for s, e in zip(starts, ends, strict=True)])


def edit(text: str | None, tree: Tree, edits: list[tuple[int, int, str]], one: tokenizing.Encoder) -> tuple[int, int]:
    """Apply non-overlapping edits to the tree; tokens after them and characters that were encoded again."""
    text = text or ""
    regions: list[list] = []  # first leaf, its start, last leaf, its end, edits
    for start, stop, new in sorted((max(0, min(a, len(text))), max(0, min(b, len(text))), c or "") for a, b, c in edits):
        # The characters on both sides of a cut have to stay as they are.
        first, at = tree.leaf_at(start - 2)
        last, last_at = tree.leaf_at(stop + 1)
        end = last_at + tree.chars(last)
        if regions and regions[-1][2] >= first:
            regions[-1][2:4] = max(regions[-1][2], last), max(regions[-1][3], end)
            regions[-1][4].append((start, stop, new))
        else:
            regions.append([first, at, last, end, [(start, stop, new)]])
    again = 0
    for first, at, last, end, changes in reversed(regions):
        parts, place = [], at
        for start, stop, new in changes:
            parts += [text[place : max(place, start)], new]
            place = max(place, stop)
        region = "".join(parts) + text[place:end]
        again += len(region)
        tree.put(first, len(region), len(one.ids(region)) // 4)
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, 0, 0)
    return tree.tokens, again


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "text_hash": F.xxhash64(F.col("text").cast("string"))})


def build(docs: DataFrame, vocabulary: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, text_hash, n_tokens, tree for each distinct row of ``docs(doc_id, text)``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_tokens", pa.int64()), ("tree", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizing.encoder(vocabulary)
        for keys, hashes, texts in tx.rows(batches, "doc_id", "text_hash", "text"):
            trees = [grow(t, one, leaf) for t in texts]
            yield tx.batch(schema, keys, hashes, [t.tokens for t in trees], [t.sums.astype("<i4").tobytes() for t in trees])

    rows = _keyed(docs).select("doc_id", "text_hash", "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_tokens long, tree binary").dropDuplicates(["doc_id", "text_hash"])


def recount(docs: DataFrame, trees: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded for each row of ``docs(doc_id, text, edits)``."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = tokenizing.encoder(vocabulary)
        for keys, counts, texts, edits, stored in tx.rows(batches, "doc_id", "n_tokens", "text", "edits", "tree"):
            out = []
            for key, n, text, changes, sums in zip(keys, counts, texts, edits, stored, strict=True):
                changes = [(c["start"], c["stop"], c["replacement"]) for c in changes or []]
                after, again = n, 0
                if changes:
                    tree = Tree(np.frombuffer(sums, dtype="<i4").reshape(2, -1).astype(np.int64))
                    after, again = edit(text, tree, changes, one)
                out.append((key, n, len(changes), after, again))
            yield tx.batch(schema, *zip(*out, strict=True)) if out else tx.batch(schema, [], [], [], [], [])

    edited, kept = _keyed(docs).select("doc_id", "text_hash", "text", "edits"), trees.select(F.col("doc_id").alias("key"), F.col("text_hash").alias("hash"), "n_tokens", "tree")
    # A text without edits stays where it is: only its key goes to the trees.
    slim = edited.withColumn("text", F.when(F.size(F.coalesce("edits", F.array())) > 0, F.col("text")))
    joined = slim.join(kept, slim["doc_id"].eqNullSafe(kept["key"]) & (slim["text_hash"] == kept["hash"]))
    return joined.select("doc_id", "n_tokens", "text", "edits", "tree").mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def replacements(text: Column, pattern: str, replacement: str) -> Column:
    """Edits that put ``replacement`` for every match of a pattern (without groups), from SQL functions."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,replacement:string>>").alias("edits"))

    def add(held: Column, i: Column) -> Column:
        start = held["at"] + F.length(F.get(gaps, i))
        stop = start + F.length(F.get(found, i))
        return F.struct(stop.alias("at"), F.concat(held["edits"], F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(replacement).alias("replacement")))).alias("edits"))

    steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(text.isNotNull(), F.aggregate(steps, state, add)["edits"])
