"""Divergence of sources against a plain count, with digests that collide."""

import re
from collections import Counter

import pytest

from gridlapse.llm import divergence
from tests.llm.frames import odd_rows, prose

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest int, own string, low string, p int"


def rows_of():
    rows = [(d, t, lang, source) for k, (d, t) in enumerate(odd_rows()) for lang, source in [(("en", "de", None)[k % 3], ("a", "b", None, "")[k % 4])]]
    for i in range(160):
        words = prose(i // 3, 30).split(" ")
        rows.append((i, " ".join(words[i % 7 :]) + " Straße ÉTÉ x1y the THE", ("en", "de")[i % 2], f"s{(i * i) % 5}"))
    return rows + [(900, None, "xx", "s0"), (901, "alone", "xx", "s1"), (902, "", "yy", "only")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "o", "l", 2) for r in rows], SCHEMA)


def plain(rows, least=10, top=10):
    def terms(text):
        return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    docs = [(lang or "", source or "", terms(text)) for _, text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= least]
        groups = {source: Counter() for own, source, _ in docs if own == lang}
        for own, source, words in docs:
            if own == lang:
                groups[source].update(w for w in words if seen[w] >= least)

        def shares(n):
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)

        own = {s: shares(n) for s, n in groups.items()}
        whole = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted((-sum(far(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            best = sorted((-far(own[s][t], whole[t]), t.encode(), t) for t in kept if groups[s][t] and own[s][t] > whole[t])
            found += [(lang, s, "pair", x[2], -x[0], k) for k, x in enumerate(pairs, 1)]
            found += [(lang, s, "term", x[2], -x[0], k) for k, x in enumerate(best[:top], 1)]
    return sorted(found)


@pytest.mark.parametrize("bits", [2, 8, 64])
def test_audit_with_digests_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "HELD", 300)
    monkeypatch.setattr(divergence, "PIECE", 50)
    rows = rows_of()
    got = divergence.audit(frame(spark, rows).repartition(5), bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_other_limits_and_no_documents(spark):
    rows = rows_of()
    got = divergence.audit(frame(spark, rows), documents=3, top=4)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 4)
    assert divergence.audit(frame(spark, [])).count() == 0
    few = divergence.audit(frame(spark, rows[-3:])).collect()  # no kept terms
    assert sorted(tuple(r)[:6] for r in few) == [("xx", "s0", "pair", "s1", 0, 1), ("xx", "s1", "pair", "s0", 0, 1)]


def test_terms_of_a_long_text_come_whole():
    text = prose(3, 4000).encode() + " Ünï中".encode() * 900
    assert [w for piece in divergence.words(text * 40) for w in piece] == (text * 40).translate(divergence.FOLD).split()
    assert set(divergence.digests_of([str(i).encode() for i in range(50)], 2).tolist()) == {0, 1, 2, 3}
    assert len(set(divergence.digests_of([str(i).encode() for i in range(50)], 64).tolist())) == 50
