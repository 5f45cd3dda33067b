"""The pipeline against a plain one, stage by stage, on small tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridlapse.llm import crf
from tests.llm.frames import edited, prose
from tests.llm.test_near import plain_components
from tests.llm.test_text import WORD, five, junk, plain_targets

import xxhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    items = [(i, prose(7000 + i, 20 + 3 * i)) for i in range(6)]
    for i in range(120):
        good = i % 5 != 0
        text = "\n".join(prose(3000 + 10 * i + k, 20) for k in range(4))
        if i % 17 == 3:
            text += "\n" + items[i % 6][1]
        rows.append((i, text if good else text.split("\n")[0] + "\n" + junk(i), "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    base = "\n".join(prose(100 + k, 40) for k in range(5))
    rows += [(200 + i, edited(base, i, 0.02), "en", "s0", 1) for i in range(8)] + [(300 + i, rows[1][1], "de", "s1", 1) for i in range(3)]
    rows += [(400, None, None, None, None), (401, "", "en", "s9", 0), (402, prose(9, 3000), "en", None, 1), rows[2]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{where}/benchmark.parquet")
    return where, rows, items


def plain_print(text, words, repeats):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [b" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in (shingles if repeats else set(shingles))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def one_of_each(rows):
    prints = [(plain_print(r[1], 1, False), plain_print(r[1], 5, True)) for r in rows]
    roots = plain_components(prints, lambda a, b: (a[0] ^ b[0]).bit_count() <= 8 and (a[1] ^ b[1]).bit_count() <= 12)
    kept = {}
    for root, row in zip(roots, rows):
        if root not in kept or row[0] < kept[root][0]:
            kept[root] = row
    return list(kept.values())


def mixed(rows):
    size = {r: len(WORD.findall(r[1] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r]
    targets, made = plain_targets(sizes), []

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    for source in sizes:
        own = [r for r in rows if r[3] == source]
        named = {r: md5(f"{r[0]}|{'-' if source is None else source}|{md5(r[1] or '')}") for r in own}
        own.sort(key=lambda r: (md5(f"0|{named[r]}")[:13], named[r]))
        budget = math.floor(targets[source] + 1e-9)
        epochs, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        for r in own:
            extra = min(size[r], rest)
            rest -= extra
            if size[r]:
                made += [r] * (epochs + (extra == size[r]))
                if 0 < extra < size[r]:
                    end = list(WORD.finditer(r[1]))[extra - 1].end()
                    made.append((r[0], r[1][:end], *r[2:]))
    return made


def test_pipeline_equals_a_plain_one(spark, tables):
    where, rows, items = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = crf.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    scores = crf.scores([(r[1] or "").encode() for r in rows], model)
    want = [r for r, s in zip(rows, scores) if s >= 0.7]
    assert 60 < len(want) < len(rows) - 15
    stages = [want]
    stages.append(one_of_each(want))
    stages.append([r for r in stages[-1] if not any(len(five(i) & five(r[1])) >= 0.8 * len(five(i)) for _, i in items)])
    stages.append(mixed(stages[-1]))
    frame, kept = docs, []
    for _, function in corpus_pipeline.STAGES[:4]:
        path = f"{where}/stage-{len(kept)}"
        function(spark, frame, where).write.parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == docs.columns
        kept.append([tuple(r) for r in frame.collect()])
    for got, plain in zip(kept, stages):
        assert sorted(got, key=str) == sorted(plain, key=str)
    assert len(stages[0]) > len(stages[1]) > len(stages[2])
    tokenizer, start, records = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(stages[3], key=lambda r: (r[0], r[1])):
        ids = np.array(tokenizer.encode(r[1], add_special_tokens=False).ids + [2], dtype="<u4")
        records.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, where).collect()) == sorted(records)


def test_stages_take_an_empty_table(spark, tables):
    where, _, _ = tables
    frame = spark.read.parquet(f"{where}/documents.parquet").where("doc_id < 0")
    for _, function in corpus_pipeline.STAGES:
        out = function(spark, frame, where)
        assert out.count() == 0
        frame = out if out.columns == frame.columns else frame


def test_words_are_what_the_mix_counts():
    assert [m.group() for m in re.finditer(WORD, " a\x0b b\x1cc ")] == ["a", "b\x1cc"]
