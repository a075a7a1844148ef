"""Coded ids, packing, sharding, quality rules, the language model and the classifier."""

import math
import random
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import AWKWARD, WORD, documents, token_ids
from wickstore.llm import kneser_ney, packing, rules, shards, simple8b, toxicity
from wickstore.llm.queries import QUERIES

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def checksum(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize(
    "ids",
    [
        [],
        [7],
        [0] * 3000,
        [2**63, 5, 2**61, 2**59] * 600,
        [n % 50257 for n in range(0, 400_000, 77)],
        [1, 2, 3] * 1000 + [2**40] * 100 + [9] * 2000,
    ],
)
def test_words_round_trip(ids):
    given = np.array(ids, np.uint64)
    words, escapes, first_word, first_escape = simple8b.encode(given)
    assert (simple8b.decode(words, escapes, first_word, len(given)) == given).all()
    assert len(first_word) == len(first_escape) == -(-len(given) // simple8b.BLOCK)


def test_greedy_words_are_dense():
    assert len(simple8b.encode(np.zeros(1024, np.uint64))[0]) == 1
    assert len(simple8b.encode(np.tile(np.array([0, 1], np.uint64), 60))[0]) == 2
    assert len(simple8b.encode(np.arange(32000, 32400).astype(np.uint64))[0]) == 100


def test_coded_documents_match_the_tokenizer(spark):
    rows = [(n * 3 % 17, t) for n, t in enumerate(AWKWARD)] + [(None, "no id"), (5, "again"), (5, "again")]
    got = simple8b.read_ids(simple8b.write_ids(documents(spark, rows), public_tokenizers.path(BYTES), 2), with_ids=True)
    got = sorted(got.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter(
        (d, (*token_ids(BYTES, t), 2)) for d, t in rows
    )
    before = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(r.ids), checksum(r.ids))
        before += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_coded_query_covers_documents(spark, sf_dir):
    got = sorted(QUERIES["op2_simple8b"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    assert [r.doc_id for r in got] == [d for d, _ in texts]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    for n in range(0, len(texts), 37):
        assert got[n].ids_crc32 == checksum([*token_ids(BYTES, texts[n][1]), 2])


def check_packing(rows, texts):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = [*token_ids(WORDS, text), 1]
        own = sorted(pieces.pop(doc), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == checksum(ids[r.start : r.start + r.length]) for r in own)
    assert not pieces
    padded = total = 0
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        size = sum(r.length for r in own)
        assert size <= 2048
        total += size
        padded += 0 if size & (size - 1) == 0 else 2048 - size
    return padded / total


def test_packing_of_awkward_rows(spark):
    check_packing(
        packing.sequences(documents(spark, AWKWARD), public_tokenizers.path(WORDS)).collect(), dict(enumerate(AWKWARD))
    )


def test_packing_query_wastes_little(spark, sf_dir):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    assert check_packing(QUERIES["op9_packing"](spark, sf_dir).collect(), texts) < 0.03


EMPTY_SHARD = kneser_ney.Shard(np.zeros(0, np.int64), np.zeros(0), 0, 1)


class Grabbed:
    """Stands for a table and keeps the function that would run over its batches."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *args, **kwargs: self


@pytest.mark.parametrize(
    "made, most",
    [
        (lambda docs: packing.pieces(docs, public_tokenizers.path(WORDS), 1), 45),
        (kneser_ney.gram_counts, 130),
        (lambda docs: kneser_ney._scored(docs, SimpleNamespace(value=EMPTY_SHARD)), 190),
    ],
)
def test_workers_hold_little_beside_a_batch(spark, made, most):
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(names, k=300)) for _ in range(4000)]
    columns = {"doc_id": range(4000), "row": range(4000), "half": [0] * 4000, "lang": ["en"] * 4000, "text": texts}
    batch = pa.record_batch({c: pa.array(v) for c, v in columns.items()})
    docs = Grabbed()
    made(docs)
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in docs.run([batch]))
        assert tracemalloc.get_traced_memory()[1] < most << 20
    finally:
        tracemalloc.stop()


def test_differencing_is_even_and_grows():
    rng = random.Random(1)
    sizes = [rng.randint(1, 512) for _ in range(400)]
    windows = packing.packed(sizes)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400))
    assert max(sums) <= 2048 and max(sums) - min(sums) < 40
    assert len(packing.packed([1500, 1500, 1000])) == 3  # two windows' worth, but no two of them fit together
    assert packing.packed([]) == []


def test_shards_are_even_and_keep_groups(spark, sf_dir):
    got = QUERIES["op4_balanced_shards"](spark, sf_dir).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for shard, count in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(count))
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    homes = defaultdict(set)
    for r in got:
        homes[texts[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_a_third_of_equal_rows_is_split_no_more_than_needed(spark):
    rows = [(n, "hot text") for n in range(200)] + [(1000 + n, f"text {n // 2}") for n in range(400)]
    rows += [(None, None), (None, ""), (5, "hot text"), (5, "hot text")]
    got = shards.balanced(documents(spark, rows)).collect()
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    homes = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id >= 1000:
            homes[(r.doc_id - 1000) // 2].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 20
    assert shards.balanced(documents(spark, rows).limit(0)).count() == 0


def base_counts(text):
    text = text or ""
    found = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(found[n : n + 5]) for n in range(len(found) - 4)]
    times = Counter(runs)
    covered = {n + k for n, run in enumerate(runs) if times[run] > 1 for k in range(5)}
    return (
        len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered),
        len(found) < 10 or 100 * len(covered) > 20 * len(found),
    )


def test_quality_counts_match_plain_ones(spark, sf_dir):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
    got = QUERIES["op7_quality_rules"](spark, sf_dir).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[n] for n in names) == base_counts(texts[r.doc_id])
        assert r.kept == (not r.base_failed and not r.outlier)
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    good = [r for r in got if labels.get(r.doc_id) == 1]
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    got = {r.doc_id: r for r in rules.quality(docs).collect()}
    for n, text in enumerate(AWKWARD):
        assert (got[n].n_words, got[n].n_dup_lines, got[n].base_failed) == tuple(base_counts(text)[i] for i in (0, 3, 5))
    assert rules.quality(docs.limit(0)).count() == 0


def test_outliers_of_a_skewed_group(spark):
    rng = random.Random(4)
    say = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90)))
    texts = [say() for _ in range(300)] + [" ".join("#$%&*" for _ in range(60)), "A" * 900 + " B" * 30]
    got = {r.doc_id: r.outlier for r in rules.quality(documents(spark, texts)).collect()}
    assert [n for n, out in got.items() if out] == [300, 301]


def test_outliers_of_small_groups(spark):
    rng = random.Random(5)
    say = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(10, 90)))
    rows = [(n, say(), "en" if n % 2 else None, f"s{n % 60}") for n in range(240)]
    rows += [(240, " ".join("#$%&*" for _ in range(60)), "en", "lone"), (241, say(), "fr", "lone"), (242, None, "fr", None)]
    got = rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert sorted(r.doc_id for r in got if r.outlier) == [240, 242]


def plain_kneser_ney(texts, order):
    counts = [Counter() for _ in range(order + 1)]
    for text in texts:
        padded = b"\0" * (order - 1) + text
        for n in range(len(text)):
            counts[order][padded[n : n + order]] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1

    def discount(k):
        n = [max(1, sum(c == i for c in counts[k].values())) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        given = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(d, 0.1), i) for i, d in enumerate(given, 1)]

    off = [None, *[discount(k) for k in range(1, order + 1)]]
    followers = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for gram, c in counts[k].items():
            followers[k][gram[:-1]].append(c)

    def p(gram):
        if not gram:
            return 1 / 256
        k = len(gram)
        own = followers[k].get(gram[:-1])
        if not own:
            return p(gram[1:])
        d = lambda c: off[k][min(c, 3) - 1]
        c = counts[k][gram]
        return (max(c - d(c), 0) if c else 0) / sum(own) + sum(map(d, own)) / sum(own) * p(gram[1:])

    def log_p(text):
        padded = b"\0" * (order - 1) + text
        return sum(math.log(p(padded[n : n + order])) for n in range(len(text)))

    return log_p


@pytest.mark.parametrize("entries", [2_000_000, 100])
def test_model_matches_plain_one(spark, monkeypatch, entries):
    monkeypatch.setattr(kneser_ney, "SHARD_ENTRIES", entries)
    texts = ["the cat sat on the mat", "the dog sat on the cat", "a cat and a dog", "Ünï ist für alle", None, "", "the zebra"]
    docs = documents(spark, [*texts, (0, texts[0])])
    trusted = spark.createDataFrame([(0,), (1,), (2,), (3,), (None,), (99,)], "doc_id long")
    log_p = plain_kneser_ney([t.encode() for t in [*texts[:4], texts[0]]], kneser_ney.ORDER)
    got = kneser_ney.rated(docs, trusted).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw)
        if raw:
            assert r.perplexity == pytest.approx(math.exp(-log_p(raw) / len(raw)), rel=1e-9)
        else:
            assert r.perplexity is None and not r.kept


def test_probabilities_sum_to_one(spark):
    docs = documents(spark, ["banana bandana", "cabana"])
    counts = kneser_ney.gram_counts(docs.withColumn("half", F.col("doc_id") % 2))
    rows = kneser_ney.model(counts)[0].filter(F.col("model") == kneser_ney.WHOLE).toPandas()
    rows = rows.sort_values("entry")
    part = kneser_ney.Shard(rows["entry"].to_numpy(), rows["value"].to_numpy(), 0, 1)
    context = int.from_bytes(b"bana", "big")
    total = np.exp(part.log_probabilities((context << 8) + np.arange(256))).sum()
    assert total == pytest.approx(1)


def test_limits_of_a_language_with_few_trusted_documents(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda: " ".join(rng.choice(names) for _ in range(40))
    rows = [(n, say(), "es" if n % 100 == 0 or n >= 400 else "en") for n in range(500)]
    docs = spark.createDataFrame([*rows, (500, "#$%&*@ " * 60, "es")], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(n,) for n in range(400) if n % 100 == 0 and n < 100 or n % 100], "doc_id long")
    kept = {r.doc_id for r in kneser_ney.rated(docs, trusted).collect() if r.kept}
    assert sum(n in kept for n in range(400, 500)) >= 95 and 500 not in kept


def test_classifier_of_quality(spark, sf_dir):
    docs = documents(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long")
    assert kneser_ney.rated(docs.limit(0), none).count() == 0
    kept = {r.doc_id for r in kneser_ney.good_documents(docs, none).collect()}
    assert kept == {n for n, t in enumerate(AWKWARD) if t}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    got = {r.doc_id: r.kept for r in QUERIES["op5_kneser_ney"](spark, sf_dir).collect()}
    good = [got[d] for d, q in labels.items() if q == 1]
    bad = [got[d] for d, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_classifier_of_toxicity(spark, sf_dir):
    sf = sf_dir if "0.1" in sf_dir else sf_dir.replace("sf0.01", "sf0.1")
    got = QUERIES["op3_toxicity"](spark, sf).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    rows = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    right = sum(p and y for p, y in rows)
    assert right / sum(p for p, _ in rows) > 0.8
    assert right / sum(y for _, y in rows) > 0.7


def test_classifier_of_toxicity_on_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, (None, "no id"), (3, "one")])
    for labels in ([], [(3, 1, 1), (4, 1, 0), (4, 1, 0), (8, None, None), (None, 1, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = toxicity.scored(docs, known).collect()
        assert len(got) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), known).count() == 0
