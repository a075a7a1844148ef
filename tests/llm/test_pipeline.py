"""The stages of the pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents, shingles
from wickstore.llm.common import table


def corpus(spark, folder):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    item = say(20)
    texts = [say(rng.randint(40, 90)) for _ in range(60)]
    words = texts[5].split()
    words[3] = "changed"
    near = " ".join(words)
    texts += [near, f"{say(30)} {item} {say(30)}", texts[7] + "\n" + say(25), "#$%&*@ " * 80]
    documents(spark, [*texts, (None, say(30)), (900, None), (901, "")]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(63)], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_stages_take_effect(spark, tmp_path):
    folder = str(tmp_path)
    texts = corpus(spark, folder)
    docs = table(spark, folder, "documents")
    columns, kept = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/{n}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        if n < 4:
            assert docs.columns == columns, name
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert 63 not in kept[0] and 900 not in kept[0] and 901 not in kept[0]
    assert sum(d in kept[0] for d in range(63)) >= 61 and {60, 61, 62} <= set(kept[0])
    assert kept[1][62] == texts[62].split("\n")[1]
    assert 60 in kept[1] and 60 not in kept[2] and 5 in kept[2]
    assert 61 in kept[2] and 61 not in kept[3]
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    assert [s[0] for s in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "near dedup", "decontamination", "packing",
    ]
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, ran.drop("sequence_id", "offset").collect())) == sorted(
        map(str, docs.drop("sequence_id", "offset").collect())
    )


def test_stages_on_awkward_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    for n, docs in enumerate((documents(spark, AWKWARD), documents(spark, AWKWARD).limit(0))):
        for m, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = f"{folder}/{n}-{m}"
            stage(spark, docs, folder).write.parquet(out)
            docs = spark.read.parquet(out)
        assert (docs.count() > 0) == (n == 0)


def test_near_dedup_takes_pairs_between_80_and_85_percent(spark, tmp_path):
    rng = random.Random(80)
    rows = []
    for n in range(40):
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(rng.randint(98, 120))]
        other = list(words)
        other[30], other[60] = "changed", "changed"
        pair = [shingles(" ".join(w)) for w in (words, other)]
        assert 0.8 <= len(pair[0] & pair[1]) / len(pair[0] | pair[1]) < 0.85
        rows += [(n, " ".join(words)), (100 + n, " ".join(other))]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), str(tmp_path)).collect()}
    assert kept == set(range(40))
