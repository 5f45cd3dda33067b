"""Near copies against brute force on exact Jaccard similarity, not on fingerprints."""

import random

import numpy as np
import pytest

import corpus_pipeline
from gridlapse.llm import overlap, simhash
from tests.llm.frames import documents, edited, odd_rows, prose
from tests.llm.test_near import plain_components


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def block_edited(text, seed, n):
    """``n`` words in a row are others: many words differ, but few shingles do."""
    words, some = text.split(" "), random.Random(seed)
    at = some.randint(0, len(words) - n)
    return " ".join(words[:at] + prose(9000 + seed, n).split(" ") + words[at + n :])


def block_rows():
    rows = odd_rows()
    for k in range(30):
        base = prose(500 + k, 60 + 12 * k)
        n = len(plain_shingles(base)) // 9 - 4
        rows += [(1000 + 10 * k, base)] + [(1001 + 10 * k + j, block_edited(base, 10 * k + j, max(1, n - j))) for j in range(3)]
    line = prose(77, 40)
    return rows + [(2000 + k, line + " " + prose(800 + k, 15)) for k in range(70)]  # a common line, no copies


def family_rows():
    """One large family of near copies, of which few pairs are near, and a passage that many texts share."""
    base, passage = prose(321, 150), prose(322, 60)
    rows = [(3000 + k, edited(base, k, 0.02)) for k in range(90)]
    return rows + [(4000 + k, passage + " " + prose(5000 + k, 8 + k % 5)) for k in range(60)]


@pytest.mark.parametrize("block, frequent", [(1024, 50), (8, 50), (8, 5)])
def test_every_pair_of_jaccard_four_fifths_is_joined(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "FREQUENT", frequent)
    rows = block_rows() + family_rows()
    docs = documents(spark, rows).repartition(4)
    search = simhash.near_duplicates(docs, corpus_pipeline.NEAR)
    sets = {(d, t): plain_shingles(t) for d, t in rows}
    texts = docs.select("doc_id", "text", simhash.F.xxhash64(simhash.text_of("text")).alias("hash")).collect()
    text_of = {(r.doc_id, r.hash): (r.doc_id, r.text) for r in texts}

    def groups(found):
        return {text_of[r.doc_id, r.hash]: r.group for r in found.collect()}

    before, after = groups(search), groups(overlap.join_near(docs, search))
    keys = list(sets)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if plain_near(sets[a], sets[b])]
    assert any(before[a] != before[b] for a, b in pairs)  # fingerprints alone lose some
    assert all(after[a] == after[b] for a, b in pairs)
    # Groups are exactly those of the fingerprints, joined by the pairs.
    roots = plain_components(keys, lambda a, b: before[a] == before[b] or plain_near(sets[a], sets[b]))
    assert len(set(zip(roots, (after[k] for k in keys)))) == len(set(roots)) == len(set(after.values()))


def test_pipeline_stage_drops_copies_that_fingerprints_lose(spark):
    rows = block_rows()
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    found = [plain_shingles(r.text) for r in kept.collect()]
    assert not any(plain_near(a, b) for i, a in enumerate(found) for b in found[:i])


def test_keys_of_near_sets_meet():
    some = np.random.default_rng(3)
    for n in list(range(1, 60)) + [300, 3000]:
        union = np.unique(some.integers(0, 2**64, n, dtype=np.uint64))
        gone = some.permutation(n)[: n // 5]
        a, b = np.delete(union, gone[::2]), np.delete(union, gone[1::2])
        assert overlap.near_sets(a, b)
        for frequent in (union[:0], np.setdiff1d(union, union[gone]), union):
            assert np.intersect1d(overlap.keys_of(a, frequent), overlap.keys_of(b, frequent)).size
    assert overlap.prefix(0) == 0 and [overlap.prefix(n) for n in (1, 4, 5, 10)] == [1, 1, 2, 3]


def test_parity_maps_rule_out_no_near_pair():
    some = np.random.default_rng(6)
    for n in [1, 2, 5, 9, 10, 15, 16, 17, 33, 100, 400, 9000, 40_000]:
        union = np.unique(some.integers(0, 2**64, n, dtype=np.uint64))
        gone = some.permutation(n)[: n // 5]
        a, b = np.delete(union, gone[::2]), np.delete(union, gone[1::2])
        cell = overlap.Cell(np.array([len(a), len(b)]), [overlap.parity_map(a), overlap.parity_map(b)])
        assert overlap.near_sets(a, b) and cell.like(0, np.array([1])).tolist() == [1] and cell.like(1, np.array([0])).tolist() == [0]


def test_parity_maps_rule_out_most_others():
    some, out = np.random.default_rng(7), 0
    for n in [60, 140, 500, 2000]:
        union = np.unique(some.integers(0, 2**64, n, dtype=np.uint64))
        gone = some.permutation(n)[: n // 3]  # a similarity of two thirds
        a, b = np.delete(union, gone[::2]), np.delete(union, gone[1::2])
        out += not len(overlap.Cell(np.array([len(a), len(b)]), [overlap.parity_map(a), overlap.parity_map(b)]).like(0, np.array([1])))
    assert out == 4


def test_a_block_gives_fewer_links_than_texts():
    union = np.arange(1, 101, dtype=np.uint64)
    sets = [np.delete(union, [k]) for k in range(100)]
    cell = overlap.Cell(np.array([99] * 100), [overlap.parity_map(s) for s in sets])
    assert len(overlap.forest(cell, np.arange(100))) == 99
    assert len(overlap.forest(cell, np.arange(100) // 50)) == 1
    assert len(overlap.all_pairs(cell, np.arange(100) // 50, np.arange(100), None)) == 2500


def test_candidates_of_a_family_are_linear(spark, monkeypatch):
    seen = []
    real = overlap._near
    monkeypatch.setattr(overlap, "_near", lambda pairs, texts: (seen.append(pairs.count()), real(pairs, texts))[1])
    base = prose(321, 150)
    docs = documents(spark, [(k, edited(base, k, 0.01)) for k in range(200)])
    found = overlap.join_near(docs, simhash.near_duplicates(docs, simhash.Rule(max_bits=0, parts=1)))
    assert found.select("group").distinct().count() < 20  # few have no near copy
    assert seen[0] < 30 * 200 and seen[1] < 400


def test_texts_without_words_join_nothing(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (None, "one two")])
    found = overlap.join_near(docs, simhash.near_duplicates(docs, corpus_pipeline.NEAR))
    assert found.count() == 6 and found.columns == simhash.near_duplicates(docs, corpus_pipeline.NEAR).columns
    empty = documents(spark, [])
    assert overlap.join_near(empty, simhash.near_duplicates(empty, corpus_pipeline.NEAR)).count() == 0
