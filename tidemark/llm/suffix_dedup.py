"""Removal of repeated passages: every byte that a string of ``length`` bytes covers which starts twice in the corpus.

Every window of ``length`` bytes picks one of its k-grams, the last one with the
smallest hash, as its anchor. Equal windows have equal anchors, so they meet when
windows are gathered by anchor, and each window start belongs to one anchor
only. Neighbouring starts with one anchor form a snippet. The job:

1. One pass finds the snippets of each distinct text. Anchors that occur once are
   dropped by an aggregation; equal snippets are one row from then on.
2. Snippets are dealt to bins of bounded size by anchor. Per bin a Burrows-Wheeler
   transform is built and intervals are expanded breadth first by backward
   extension: each level fixes the borders between suffixes whose common
   prefix has just that length, and the expansion stops at ``length``. Borders not
   fixed by then lie between suffixes that share at least ``length`` bytes.
3. An anchor with very many different snippets, as at the edges of a passage that
   a large part of the corpus holds, is split first: windows are taken in blocks,
   aligned to the anchor, and blocks meet by their core, the bytes that all windows of a
   block hold. Equal windows have equal cores, equal blocks are one row, and a block
   whose core stands alone is dropped. Cores that are still crowded are split
   into smaller blocks, down to single windows, so that every group fits a bin and all are expanded.
4. Covered spans go back to all texts with the snippet, are merged and cut out.

Texts of which there are copies are removed whole if they are long enough, and
one of the copies stands for all in the steps above.

Defined results: null and empty texts have no bytes and lose none; texts under
``length`` bytes lose none; repeated rows are copies of each other. Rows are told
apart by doc_id (nulls included) and text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import prefilter
from tidemark.llm import text as tx
from tidemark.session import cut_lineage

LENGTH = 200
GRAM = 32
#: Bytes of the snippets in a bin, about.
BIN_BYTES = 1 << 19
#: Bytes of the texts that are hashed at once, about.
HASHED_BYTES = 1 << 16
#: Different snippets of an anchor, or blocks of a core, above which they are split.
CROWD = 128
#: Window starts in a block, from one splitting to the next.
BLOCKS = (64, 16, 4, 1)
#: Bits of a rank that hold a place; Spark's texts have at most 2**31 bytes.
_PLACE_BITS = 32


def snippets(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, anchor hash, snippet hash, first window start and number of window starts of each snippet of the texts.

    The texts are hashed as one array, so that short ones do not pay for each step; no window reaches beyond its text.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    stop = np.cumsum(sizes)
    if not (sizes >= length).any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    prefix = tx.prefix_hash(np.frombuffer(b"".join(texts), dtype=np.uint8))
    anchor, hashes = _anchors(prefix, length, gram)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    at = np.flatnonzero(np.arange(length, length + len(anchor)) <= stop[owner])
    cut = np.flatnonzero((np.diff(anchor[at], prepend=-1) != 0) | (np.diff(owner[at], prepend=-1) != 0))
    first, n = at[cut], np.diff(cut, append=len(at))
    of = owner[first]
    return of, hashes[anchor[first]].view(np.int64), tx.span_hash(prefix, first, first + n + (length - 1)).view(np.int64), first - (stop - sizes)[of], n


def _anchors(prefix: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window, and the hashes of all k-grams, from the prefix hashes of a text."""
    at = np.arange(len(prefix) - gram)
    hashes = tx.span_hash(prefix, slice(0, len(at)), slice(gram, None))
    # Smaller hash first, then the later place; the place is kept in the low bits.
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = (hashes & ~mask) | (mask - (at.astype(np.uint64) & mask))
    width = length - gram + 1
    low = _sliding_min(ranked, width)
    anchor = np.arange(len(low)) + ((mask - (low & mask)).astype(np.int64) - np.arange(len(low))) % (1 << _PLACE_BITS)
    return anchor, hashes


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from those of runs of half the width."""
    reach = 1
    while 2 * reach <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), 2 * reach
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :])


def _codes(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols, numbered without gaps (0 stays), and how many there are."""
    present = np.bincount(symbols, minlength=257) > 0
    present[0] = True
    number = np.cumsum(present) - 1
    return number.astype(np.uint8 if number[-1] < 256 else np.uint16)[symbols], int(number[-1]) + 1


def _sorted(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys below ``2**bits``, and the keys in it; key and place are sorted as one number where they fit."""
    place = max(1, (len(keys) - 1).bit_length())
    if bits + place > 64:
        order = np.argsort(keys)
        return order, keys[order]
    both = keys << np.uint64(place)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << place) - 1)).view(np.int64), both >> np.uint64(place)


def _suffixes(codes: np.ndarray, letters: int, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts of the suffixes in the order of their first ``depth`` symbols at least, the seed of each start, and the symbols in a seed.

    A seed is the number that a suffix's first symbols make.
    """
    n = len(codes)
    room = 64 - max(1, (n - 1).bit_length())
    first = 1
    while first < depth and (letters ** (first + 1) - 1).bit_length() <= room:
        first += 1
    padded = np.zeros(n + first, dtype=np.uint64)
    padded[:n] = codes
    seeds = padded[:n].copy()
    for i in range(1, first):
        seeds *= np.uint64(letters)
        seeds += padded[i : n + i]
    order, keys = _sorted(seeds, (letters**first - 1).bit_length())
    reach, bits = first, n.bit_length()
    while True:
        fresh = np.ones(n, dtype=bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        if reach >= depth or fresh.all():
            return order, seeds, first
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(fresh.astype(np.uint64))
        key = rank << np.uint64(bits)
        key[: max(0, n - reach)] |= rank[reach:]
        order, keys = _sorted(key, 2 * bits)
        reach *= 2


def repeated_borders(codes: np.ndarray, letters: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for each place of it whether the suffix differs from the one before within ``length`` symbols.

    Code 0 ends a text; strings that hold it are not extended. The expansion starts from the intervals of all seeds at once,
    which are the strings of its first levels. At each level an interval is followed if its end is a border of just that level: the borders of
    the next one lie in the extensions of these alone.
    """
    n = len(codes)
    order, seeds, first = _suffixes(codes, letters, length)
    before = codes[order - 1]
    back = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)  # place in the order of the suffix that starts one symbol earlier
    back[np.argsort(before, kind="stable")] = np.arange(n)
    keys = seeds[order]
    fixed = np.ones(n + 1, dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=fixed[1:n])
    edges = np.flatnonzero(fixed)
    low, high = edges[:-1], edges[1:]
    # Seeds that differ from the next one in their last symbol alone, and hold no end.
    stem = keys[low] // np.uint64(letters)
    ends = np.cumsum(np.concatenate(([0], codes == 0, np.ones(first, dtype=bool))))
    open_ = np.append(stem[1:] == stem[:-1], False) & (ends[order[low] + first] == ends[order[low]])
    low, high = low[open_], high[open_]
    for _ in range(length - first):
        size = high - low
        place = np.repeat(low - (np.cumsum(size) - size), size)
        place += np.arange(len(place))
        letter = before[place]
        # Places rise, so this is the order of the places one symbol earlier, too.
        by = np.argsort(letter, kind="stable")[len(letter) - np.count_nonzero(letter) :]
        letter = letter[by]
        if not len(by):
            break
        inside = np.repeat(np.arange(len(low)), size)[by]
        fresh = np.ones(len(by), dtype=bool)
        np.not_equal(inside[1:], inside[:-1], out=fresh[1:])
        fresh[1:] |= letter[1:] != letter[:-1]
        cut = np.flatnonzero(fresh)
        begin = back[place[by[cut]]].astype(np.int64)
        end = begin + np.diff(cut, append=len(by))
        fresh = ~fixed[end]
        low, high = begin[fresh], end[fresh]
        fixed[high] = True
    return order, fixed[:n]


def _repeated(texts: list[bytes], weights: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window starts at each place of the texts, laid end to end with a place between, that starts elsewhere, too; and the starts of the texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    symbols = joined.astype(np.int16) + 1
    symbols[starts + sizes] = 0
    order, borders = repeated_borders(*_codes(symbols), length)
    run = np.cumsum(borders.astype(np.int64))
    worth = np.repeat(np.asarray(weights, dtype=np.int64), sizes + 1)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(symbols))
    worth[left < length] = 0
    held = np.bincount(run, weights=worth[order])
    again = np.zeros(len(symbols), dtype=bool)
    again[order] = held[run] >= 2
    again[left < length] = False
    return again, starts


def repeated_windows(texts: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows of ``length`` bytes start at two places at least; a text counts ``weight`` times."""
    again, starts = _repeated(texts, weights, length)
    return [again[s : s + max(0, len(t) - length + 1)] for s, t in zip(starts, texts, strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, kind (text hash), kind2, row (hash of both), text as bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumns({"kind": F.xxhash64("text"), "kind2": F.xxhash64("text", F.lit(1))}).withColumn("row", F.xxhash64("doc_id", "kind2"))


def row_hash(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``__row`` that ``cut_repeats`` names them by."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text, F.lit(1))))


def _groups(batch: pa.RecordBatch, seen: set[int], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """kind, row and text of the texts of ``length`` bytes or more that were not seen, some ``HASHED_BYTES`` at a time."""
    group, held = [], 0
    for kind, row, text in zip(batch.column("kind").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
        if kind in seen:
            continue
        seen.add(kind)
        data = text.as_buffer()
        if data.size < length:
            continue
        group.append((kind, row, data.to_pybytes()))
        held += data.size
        if held >= HASHED_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def _occurrences(rows: DataFrame, length: int) -> DataFrame:
    """anchor, snippet, kind, at, n, row of every snippet of every text, copies within a task once."""
    schema = pa.schema([("anchor", pa.int64()), ("snippet", pa.int64()), ("kind", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("row", pa.int64())])

    @tx.lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.other_work()
        seen: set[int] = set()
        for b in batches:
            parts = []
            for group in _groups(b, seen, length):
                kind, row, texts = zip(*group, strict=True)
                of, anchor, snippet, at, n = snippets(list(texts), length)
                parts.append((anchor, snippet, np.array(kind)[of], at, n, np.array(row)[of]))
            if parts:
                yield tx.batch(schema, *(np.concatenate(c).astype(f.type.to_pandas_dtype()) for c, f in zip(zip(*parts, strict=True), schema, strict=True)))

    return rows.select("kind", "row", "text").mapInArrow(find, "anchor long, snippet long, kind long, at int, n int, row long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """kind, spans (array of struct<start,stop>, unmerged) for every text hash with windows that occur elsewhere."""
    spark = docs.sparkSession
    rows = _rows(docs)
    all_of_them = cut_lineage(_occurrences(rows, length), "occurrences")
    place = F.struct("kind", "at")
    counted = all_of_them.groupBy("anchor").agg(F.min("snippet").alias("s"), F.max("snippet").alias("t"), F.min(place).alias("p"), F.max(place).alias("q"))
    # Written, so that the join below reads two plain shuffles, of which a hot anchor's part can be split.
    shared = cut_lineage(counted.filter("s <> t or p <> q").select("anchor"), "shared")
    repeated = cut_lineage(all_of_them.join(shared, "anchor"), "repeated")

    classes = cut_lineage(
        repeated.groupBy("anchor", "snippet").agg(
            F.min(F.struct("kind", "at", "n", "row")).alias("rep"), F.when(F.min(place) != F.max(place), 2).otherwise(1).alias("weight")
        ),
        "classes",
    )
    # The bytes of one snippet per class, cut from the texts that hold them.
    asked = classes.select(F.col("anchor").alias("key"), "snippet", "rep.row", "rep.at", "rep.n", "weight")
    texts = prefilter.may_hold(rows.select("row", "text"), prefilter.bits_of(classes.select("rep.row"), "row"), F.col("row")).dropDuplicates(["row"])
    piece = F.substring("text", F.col("at") + 1, F.col("n") + (length - 1))
    cut = cut_lineage(asked.join(texts, "row").select("key", F.col("snippet").alias("string"), "weight", piece.alias("bytes")), "snippets")
    runs = cut_lineage(_expanded(cut, length, crowd, tuple(b for b in BLOCKS if 2 * b <= length)), "runs").select(F.col("key").alias("anchor"), F.col("string").alias("snippet"), "low", "high")
    moved = F.struct((F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") - 1 + length).alias("stop"))
    spans = repeated.join(runs, ["anchor", "snippet"]).select("kind", moved.alias("span"))
    return spans.groupBy("kind").agg(F.collect_list("span").alias("spans"))


def _expanded(strings: DataFrame, length: int, crowd: int, blocks: tuple[int, ...]) -> DataFrame:
    """key, string, low, high: the repeated windows of ``strings(key, string, weight, bytes)``, as runs of window starts.

    Strings of one key are compared; ``weight`` is how often one occurs. ``blocks``: sizes to split crowded keys by.
    """
    spark = strings.sparkSession
    crowds = cut_lineage(strings.groupBy("key").agg(F.count(F.lit(1)).alias("different")).filter(F.col("different") > crowd).select("key"), "crowds")
    if not blocks or crowds.isEmpty():
        return _transformed(strings, length)
    crowded = strings.join(crowds, "key")
    pieces = cut_lineage(_split(crowded, length, blocks[0]), "pieces")
    different = pieces.groupBy("core", "piece").agg(F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"), F.min("bytes").alias("bytes"))
    different = cut_lineage(different, "different")
    again = cut_lineage(different.groupBy("core").agg(F.sum("weight").alias("held")).filter("held >= 2").select("core"), "again")
    kept = cut_lineage(different.join(again, "core").select(F.col("core").alias("key"), F.col("piece").alias("string"), "weight", "bytes"), "kept")
    found = cut_lineage(_expanded(kept, length, crowd, blocks[1:]), "found").select(F.col("key").alias("core"), F.col("string").alias("piece"), "low", "high")
    back = pieces.select("core", "piece", "key", "string", "begin").join(found, ["core", "piece"])
    moved = back.select("key", "string", (F.col("low") + F.col("begin")).alias("low"), (F.col("high") + F.col("begin")).alias("high"))
    return _transformed(strings.join(crowds, "key", "left_anti"), length).union(moved)


def _transformed(strings: DataFrame, length: int) -> DataFrame:
    """The same by a Burrows-Wheeler transform for each bin of keys."""
    total = strings.agg(F.sum(F.length("bytes"))).first()[0] or 0
    bins = int(total // BIN_BYTES) + int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        again, starts = _repeated(pdf["bytes"].tolist(), pdf["weight"].tolist(), length)
        # No window starts at the last place of a text, so no run goes on into the next one.
        edges = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        low, high = edges[::2], edges[1::2]
        of = np.searchsorted(starts, low, side="right") - 1
        return pd.DataFrame({"key": pdf["key"].to_numpy()[of], "string": pdf["string"].to_numpy()[of], "low": low - starts[of], "high": high - starts[of]})

    binned = strings.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins)))
    return binned.groupBy("bin").applyInPandas(expand, "key long, string long, low int, high int")


def _split(crowded: DataFrame, length: int, block: int) -> DataFrame:
    """core, piece (hashes), key, string, begin, weight, bytes: the windows of each string in blocks that are aligned to its anchor.

    The first and the last block hold the windows of the string alone; their core lies in it all the same.
    """
    schema = pa.schema([("core", pa.int64()), ("piece", pa.int64()), ("key", pa.int64()), ("string", pa.int64()), ("begin", pa.int32()), ("weight", pa.int32()), ("bytes", pa.binary())])

    @tx.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, names, weights, texts in tx.rows(batches, "key", "string", "weight", "bytes"):
            out = []
            for key, name, w, t in zip(keys, names, weights, texts, strict=True):
                prefix = tx.prefix_hash(np.frombuffer(t, dtype=np.uint8))
                place, n = int(_anchors(prefix, length)[0][0]), len(t) - length + 1
                begin = np.arange(place % block - block if place % block else 0, n, block)
                cores = tx.mix(tx.span_hash(prefix, begin + block - 1, begin + length) ^ (place - begin).astype(np.uint64), block).view(np.int64)
                first, stop = np.maximum(begin, 0), np.minimum(begin + block, n)
                pieces = tx.span_hash(prefix, first, stop + length - 1).view(np.int64)
                out += [(c, p, key, name, x, w, t[x : y + length - 1]) for c, p, x, y in zip(cores.tolist(), pieces.tolist(), first.tolist(), stop.tolist(), strict=True)]
            if out:
                yield tx.batch(schema, *zip(*out, strict=True))

    return crowded.select("key", "string", "weight", "bytes").mapInArrow(cut, "core long, piece long, key long, string long, begin int, weight int, bytes binary")


def cut_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs(doc_id, text)``; if asked for, kept too: the rest as whole characters, null where the text is unchanged."""
    rows = _rows(docs)
    measured = cut_lineage(rows.select("doc_id", "kind", "kind2", "row", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "measured")
    copies = measured.groupBy("kind", "kind2").agg(F.count(F.lit(1)).alias("copies"))
    spans = repeated_spans(docs, length)
    known = cut_lineage(measured.join(copies.filter("copies > 1"), ["kind", "kind2"], "left"), "known")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    wanted = cut_lineage(known.filter("copies is null").select("row", "kind").join(spans, "kind").select("row", "spans"), "wanted")
    schema = pa.schema([("row", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.binary())])

    @tx.lean
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, found in tx.rows(batches, "row", "text", "spans"):
            out = []
            for key, text, pairs in zip(keys, texts, found, strict=True):
                cover = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(cover, [p["start"] for p in pairs], 1)
                np.add.at(cover, [p["stop"] for p in pairs], -1)
                covered = np.cumsum(cover)[:-1] > 0
                kept = np.frombuffer(text, dtype=np.uint8)[~covered].tobytes()
                whole = kept.decode("utf-8", "ignore").encode() if with_text else None
                out.append((key, int(covered.sum()), len(_runs(covered)), hashlib.sha256(kept).hexdigest(), whole))
            if out:
                yield tx.batch(schema, *zip(*out, strict=True))

    texts = prefilter.may_hold(rows.select("row", "text"), prefilter.bits_of(wanted, "row"), F.col("row"))
    # Not broadcast: see ngram_join._member_sets.
    edited = texts.join(wanted.hint("merge"), "row").mapInArrow(remove, "row long, removed long, spans long, kept_sha string, kept binary")
    empty = hashlib.sha256(b"").hexdigest()
    result = known.join(edited, "row", "left").select(
        "row",
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return result if with_text else result.drop("kept")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs(doc_id, text)``."""
    return cut_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
