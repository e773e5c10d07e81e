"""Operators on documents against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import components, decontaminate, language_id, ngram_join, packing, signature_tree, suffix_dedup, token_counts, token_files, tokenizing
from tidemark.session import cut_lineage, scratch_path

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def brute_components(rows, size, num, den):
    """doc_id -> component, over rows (doc_id, text)."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is None or b is None or not s or not t or a == b:
                continue
            if den * len(s & t) >= num * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in parent}


@pytest.mark.parametrize(("size", "num", "bound"), [(3, 90, ngram_join.BIN_SHINGLES), (5, 80, 150), (2, 60, 40)])
def test_ngram_join(docs, corpus, size, num, bound):
    rows = [(r[0], r[1]) for r in corpus]
    found = ngram_join.join(docs, size, num, 100, bound).collect()
    expected = brute_components(rows, size, num, 100)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == Counter((d, len(shingles(t, size)), expected.get(d)) for d, t in rows)


def test_ngram_join_of_a_large_group(spark):
    """Near copies in many bins of a split block, chained so that ends do not link."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        mine = list(words)
        for k in range(min(i, 59)):
            if k < i // 2:
                mine[k] = f"x{k}"
        rows.append((i, " ".join(mine)))
    rows += [(1000 + i, " ".join(f"y{i}z{j}" for j in range(30))) for i in range(20)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, 100, 200).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(rows, 3, 80, 100)


def test_ngram_join_empty(no_docs):
    assert ngram_join.join(no_docs).count() == 0


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(3)
    for num in (90, 80):
        for _ in range(300):
            n = int(rng.integers(1, 400))
            base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            other = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.06])]
            other = np.unique(np.concatenate([other, rng.integers(0, 2**63, int(len(base) * rng.choice([0, 0.02, 0.05]))).astype(np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if len(other) and 100 * shared >= num * (len(base) + len(other) - shared):
                assert np.intersect1d(ngram_join._signatures(base, num, 100), ngram_join._signatures(other, num, 100)).size
                frequent = (rng.random(ngram_join.CELLS) < rng.choice([0.0, 0.1, 0.5, 0.9])).astype(np.uint8)
                assert np.intersect1d(ngram_join._signatures(base, num, 100, frequent), ngram_join._signatures(other, num, 100, frequent)).size


def test_signature_tree_keeps_all_links():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, int(rng.integers(5, 200))).astype(np.uint64)
        for _ in range(int(rng.integers(1, 6))):
            sets.append(np.unique(base[rng.random(len(base)) > 0.04]))
    sets = [s for s in sets if len(s)]
    group = np.zeros(len(sets), dtype=np.int64)
    found = list(signature_tree.links(sets, group, np.arange(len(sets)), 90, 100))
    true = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - k)]
    assert all(tuple(sorted(f)) in set(true) for f in found)
    expected = components.local_components(*np.array(true).T) if true else None
    got = components.local_components(*np.array(found).T)
    assert (expected[0] == got[0]).all() and (expected[1] == got[1]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 90), (90, 95)] + [(300, rng.randint(301, 400)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got[60] == 0 and got[200] == 90 and got[95] == 90 and 100 not in got and all(got[b] == 300 for a, b in edges if a == 300)


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, data, strict=True):
        cover = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((d, len(b), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "crowd"), [(200, 128), (60, 128), (60, 1)])
def test_suffix_dedup(docs, corpus, length, crowd):
    found = suffix_dedup.cut_repeats(docs, length) if crowd == 128 else None
    if found is None:
        spans = {r["kind"]: r["spans"] for r in suffix_dedup.repeated_spans(docs, length, crowd).collect()}
        plain = {r["kind"]: r["spans"] for r in suffix_dedup.repeated_spans(docs, length).collect()}
        cover = lambda s: {i for a, b in s for i in range(a, b)}
        assert {k: cover(v) for k, v in spans.items()} == {k: cover(v) for k, v in plain.items()}
        return
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in rows) == brute_repeats([(r[0], r[1]) for r in corpus], length)


def test_suffix_dedup_empty(no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0


def test_repeated_windows():
    rng = random.Random(2)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(rng.randint(1, 5))]
        seen = Counter(t[i : i + 6] for t in texts for i in range(len(t) - 5))
        for t, flags in zip(texts, suffix_dedup.repeated_windows(texts, [1] * len(texts), 6), strict=True):
            assert [seen[t[i : i + 6]] > 1 for i in range(len(t) - 5)] == flags.tolist()


def library_ids(path, texts):
    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    return [np.array(e.ids, dtype="<u4") for e in one.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_tokenizing(path, corpus):
    odd = [" a", "a ", "a  b", "a\n\n b", "x \n y", "tab\there", "it's we'll 'S ok’s 12½", "é ́x", "é AΣ B İx ŉ ǅ", "c <|endoftext|> d", "IT'S", "\x7f \x00 b", "a\n b\n\n c\nd", "a\x1cb"]
    texts = odd + [r[1] for r in corpus]
    assert [tokenizing.encoder(path).ids(t) for t in texts] == [i.tobytes() for i in library_ids(path, texts)]


def test_token_files(spark, docs, corpus):
    path = scratch_path(spark, "files")
    token_files.write(docs, path, BYTE_BPE, block_ids=500)
    rows = sorted(((r[0], np.append(i, 0).astype("<u4")) for r, i in zip(corpus, library_ids(BYTE_BPE, [r[1] for r in corpus]), strict=True)), key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    start, expected = 0, []
    for d, ids in rows:
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert Counter(tuple(r) for r in token_files.scan(spark, path).collect()) == Counter(expected)
    wanted = {3, 14, 40, 10**9}
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in token_files.get(spark, path, list(wanted)).collect())
    assert got == Counter((d, tuple(ids.tolist())) for d, ids in rows if d in wanted)


def test_token_files_empty(spark, no_docs):
    path = scratch_path(spark, "files")
    token_files.write(no_docs, path, BYTE_BPE)
    assert token_files.scan(spark, path).count() == 0


def test_packing(docs, corpus):
    capacity = 64
    rows = packing.pack(docs, WORD_BPE, capacity).collect()
    expected = Counter()
    for r, ids in zip(corpus, library_ids(WORD_BPE, [r[1] for r in corpus]), strict=True):
        ids = np.append(ids, 0).astype("<u4")
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            expected[(r[0], i // capacity, i, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // capacity) + 2


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, WORD_BPE).count() == 0


def test_packing_plan_uses_up_all_counts():
    rng = random.Random(3)
    for _ in range(20):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        used = Counter()
        for pattern, times in packing.plan(counts, 100):
            assert sum(pattern) <= 100 and times > 0
            for length in pattern:
                used[length] += times
        assert used == Counter(counts)
    # Greedy would put 40 behind 60; the pair 39 and 1... must not beat a full bin, and 30 gives way to 20 and 15.
    assert packing.plan({60: 1, 30: 1, 20: 1, 15: 1}, 95)[0][0] == [60, 20, 15]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_edit_counts(path, corpus):
    rng = random.Random(9)
    one = tokenizing.encoder(path)
    count = lambda t: len(one.ids(t)) // 4
    for text in [r[1] for r in corpus if r[1] is None or len(r[1]) < 6000]:
        text = text or ""
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
        edits = [(a, b, rng.choice(["", " ", "x", "new words", "\n"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        tree = token_counts.grow(text, one, 20)
        assert tree.tokens == count(text)
        after, place = [], 0
        for a, b, new in edits:
            after += [text[place:a], new]
            place = b
        assert token_counts.edit(text, tree, edits, one)[0] == count("".join(after) + text[place:])


def test_recount(spark, docs, corpus):
    from pyspark.sql import functions as F

    one = tokenizing.encoder(BYTE_BPE)
    trees = cut_lineage(token_counts.build(docs, BYTE_BPE, 64), "trees")
    edited = docs.withColumn("edits", token_counts.replacements(F.col("text"), "[0-9]{4}|b+", "<removed>"))
    rows = token_counts.recount(edited, trees, BYTE_BPE).collect()
    pattern = re.compile("[0-9]{4}|b+")
    expected = Counter((r[0], len(one.ids(r[1])) // 4, len(pattern.findall(r[1] or "")), len(one.ids(pattern.sub("<removed>", r[1] or ""))) // 4) for r in corpus)
    assert Counter(tuple(r)[:4] for r in rows) == expected


def brute_tiles(item, doc, least):
    """Greedy string tiling by its definition: the longest unmarked common run, again and again."""
    marked_i, marked_d, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in marked_i and d + n not in marked_d:
                    n += 1
                best = max(best, (n, -i, -d))
        if best[0] < least:
            return covered
        n, i, d = best[0], -best[1], -best[2]
        marked_i |= set(range(i, i + n))
        marked_d |= set(range(d, d + n))
        covered += n


def test_tiles_cover_as_much_as_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        item = rng.integers(1, 6, int(rng.integers(5, 25))).astype(np.uint64)
        doc = np.concatenate([item[7:], rng.integers(1, 9, 6).astype(np.uint64), item[:7]])
        found = decontaminate.tiles(item, doc, 3)
        assert sum(n for *_, n in found) == brute_tiles(item.tolist(), doc.tolist(), 3)


def test_decontaminate(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [" ".join(word() for _ in range(30)) for _ in range(4)] + ["Short item here"]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, items[0].upper()), (10, None), (11, "")], "item_id long, text string")
    filler = lambda n: " ".join(word() for _ in range(n))
    a, b = items[1].split()[:15], items[1].split()[15:]
    texts = {
        1: f"{filler(40)} {items[0]}. {filler(10)}",
        2: f"{filler(9)} {' '.join(b)} {filler(5)}, {' '.join(a)}",  # reordered
        3: filler(300),
        4: f"{filler(9)} {' '.join(items[2].split()[:8])} {filler(9)}",  # too little of it
        5: f"x SHORT, item: here y {items[3]} {items[0]}",
        6: None,
        7: "",
    }
    docs = spark.createDataFrame([*texts.items(), (5, texts[5]), (None, texts[1])], "doc_id long, text string").selectExpr("*", "'q' as row", "1 as seed", "2 as item_id")
    rows = {(r["doc_id"], r["n_items"], r["item_id"]) for r in decontaminate.report(docs, benchmark).collect()}
    assert rows == {(1, 1, 0), (2, 1, 1), (5, 3, 0), (None, 1, 0)}
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.limit(0)).count() == 0


def test_language_id(spark, docs, no_docs, corpus):
    rng = random.Random(4)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    rows = [(i, make("abcde" if i % 2 else "stuvé"), "aa" if i % 2 else "ss") for i in range(200)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    tested = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in tested} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "ss") and 0.9 < r["score"] <= 1 for r in tested)
    odd = Counter((r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in language_id.identify(docs).collect())
    assert odd == Counter((d, not any(c.isalpha() for c in t or ""), not any(c.isalpha() for c in t or "")) for d, t, *_ in corpus)
    assert language_id.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).limit(0).union(no_docs)).collect()} == set()
