"""SimHash, components, repeated substrings and digests against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from gridlapse.llm import digest, graph, simhash, substrings
from tests.llm.frames import by_id, documents, edited, odd_rows, prose, shuffled_records


def plain_fingerprint(text: str | None, k: int) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if near(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


def near_rows():
    base = prose(20, 300)
    return odd_rows() + [(100 + i, edited(base, i, 0.01)) for i in range(25)] + [(200 + i, base) for i in range(4)]


def test_fingerprints_and_components(spark):
    rows = near_rows()
    found = simhash.near_duplicates(documents(spark, rows))
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found.collect()), key=str)
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    lowest = {}
    for (doc_id, _), root in zip(rows, roots):
        if doc_id is not None:
            lowest[root] = min(lowest.get(root, doc_id), doc_id)
    want = sorted(((d, p, lowest.get(r)) for (d, _), p, r in zip(rows, prints, roots)), key=str)
    assert got == want


@pytest.mark.parametrize("rule", [simhash.Rule(), simhash.Rule(max_bits=8, parts=3, width=1), simhash.Rule(max_bits=3, parts=1, width=4)])
@pytest.mark.parametrize("block", [8, 4096])
def test_links_connect_all_near_fingerprints(spark, rule, block):
    some = random.Random(5)
    prints = [some.getrandbits(64) for _ in range(30)]
    for center in list(prints[:6]):
        prints += [center ^ sum(1 << b for b in some.sample(range(64), some.randint(1, rule.max_bits + 3))) for _ in range(15)]
    prints += [prints[0] ^ (1 << b) for b in range(40)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    links = [(r.fp_u, r.fp_v) for r in simhash.links(distinct, rule, block=block).collect()]
    mask = 2**64 - 1
    assert all(((u ^ v) & mask).bit_count() <= rule.max_bits for u, v in links)
    linked = {frozenset(x) for x in links}
    by_links = plain_components(signed, lambda a, b: frozenset((a, b)) in linked)
    assert by_links == plain_components(prints, lambda a, b: (a ^ b).bit_count() <= rule.max_bits)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(300, 300), (201, 200), (200, 201)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 201: 200}


def test_no_links_and_no_documents(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_keep_one_of_each_group(spark):
    rows = near_rows()
    docs = documents(spark, rows)
    rule = simhash.Rule(words=1, repeats=False, max_bits=8, parts=3, width=1, check_words=5, check_bits=12)
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs, rule))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # Texts without words are one group, and its smallest id is 1.
    want = [r for r in rows if r[0] in (4, 7, 8) or (r[0] is None and r[1])] + [(1, None), (5, prose(2, 120)), (5, prose(3, 50)), (100, edited(prose(20, 300), 0, 0.01))]
    assert got == sorted(want, key=str)


def test_keep_one_leaves_other_texts_where_they_are(spark):
    rows = [(i, prose(i, 30)) for i in range(300)] + [(1000 + i, prose(i, 30)) for i in range(40)] + [(7, prose(7, 30))]
    docs = simhash.stage(documents(spark, rows).repartition(4), "docs")
    found = simhash.stage(simhash.near_duplicates(docs), "found")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as when the list is too long for all tasks
    try:
        kept = simhash.keep_one(docs, found)
        got = kept.select("doc_id", "text").collect()
        moved = shuffled_records(kept)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.doc_id, r.text) for r in got) == [(i, prose(i, 30)) for i in range(300)]
    assert moved and max(moved) < 120  # all rows are 341, 41 of them are listed


def plain_removed(texts, length):
    count = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        yield gone


def repeated_rows():
    some = random.Random(9)
    passages = [prose(40 + i, 90) for i in range(4)]
    rows = list(odd_rows())
    for i in range(40):
        parts = [prose(1000 + i, some.randint(5, 60))]
        for _ in range(some.randint(1, 3)):
            passage = some.choice(passages)
            a = some.randint(0, 60)
            parts += [passage[a : a + some.randint(380, 520)], prose(2000 + 10 * i + len(parts), some.randint(1, 40))]
        rows.append((400 + i, " ".join(parts)))
    rows += [(500, "a" * 1000), (501, "ab" * 450), (502, "x" + "ab" * 230), (503, "abc" * 133), (504, "é" * 200), (505, "é" * 201), (506, ("ab" * 100 + "c") * 5)]
    return rows


def test_repeated_substrings(spark, monkeypatch):
    rows = repeated_rows()
    found = substrings.remove_repeats(documents(spark, rows)).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (doc_id, _), t, gone in zip(rows, texts, plain_removed(texts, 400)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        want.append((doc_id, len(t), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], bytes(b for b, g in zip(t, gone) if not g)))
    got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_parts_of_a_long_text_give_all_windows(monkeypatch):
    data = prose(3, 900).encode()
    whole = [(at + f + k) for at, _, first, count, _, _, _ in substrings.contexts(data) for f, c in zip(first, count) for k in range(c)]
    monkeypatch.setattr(substrings, "SEGMENT", 700)
    parts = [(at + f + k) for at, _, first, count, _, _, _ in substrings.contexts(data) for f, c in zip(first, count) for k in range(c)]
    assert whole == parts == list(range(len(data) - 399))


def test_nothing_to_remove(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def hash_of(text):
    found = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return found - (1 << 64) if found >> 63 else found


def test_one_id_on_many_rows(spark):
    rows = [(7, prose(i, 12)) for i in range(3000)] + [(7, prose(1, 12))] * 1500 + [(None, "x")] * 40 + [(i, prose(i, 9)) for i in range(300)]
    got = digest.compare_edited(documents(spark, rows).repartition(4)).select("doc_id", "n_chars", "edited_sha256").collect()
    lowest = -(1 << 63)
    order = sorted(rows, key=lambda r: (lowest if r[0] is None else r[0], hash_of(r[1])), reverse=True)
    want = []
    for k, (doc_id, text) in enumerate(order):
        cut = len(text) // 3
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_edited_digests(spark):
    rows = [r for r in odd_rows() if r[0] is not None] + [(20 + i, prose(50 + i, 80 + 10 * i)) for i in range(30)]
    got = digest.compare_edited(documents(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0], hash_of(r[1])), reverse=True)
    want = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        own, other, new = (digest.digest(t.encode()) for t in (text, following, changed))
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, new, digest.likeness(own, new), digest.likeness(own, other)))
    assert sorted(map(tuple, got)) == sorted(want)
    long = [r for r in got if r.doc_id >= 20]
    assert min(r.near_edited for r in long) > max(r.near_next for r in long)


def test_digest_of_one_and_of_no_document(spark):
    one = digest.compare_edited(documents(spark, [(None, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].doc_id is None
    assert digest.compare_edited(documents(spark, [])).count() == 0
    assert digest.fingerprints(documents(spark, [(1, None)])).first().fingerprint == digest.digest(b"")


def test_digest_score_is_bounded():
    prints = [digest.digest(t) for t in (b"", b"a", b"\0" * 500, prose(1, 400).encode(), bytes(range(256)) * 9)]
    for a in prints:
        for b in prints:
            assert 0.0 <= digest.likeness(a, b) <= 1.0 and digest.likeness(a, b) == digest.likeness(b, a)
        assert digest.likeness(a, a) == 1.0


def test_rows_by_id_helper(spark):
    assert by_id(documents(spark, [(1, "a")]), "text") == [(1, "a")]
