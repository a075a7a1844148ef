"""Line dedup, near-duplicates, decontamination and repeated chunks against plain versions."""

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents, edits, groups, shingles
from wickstore.llm import chunks, decontaminate, lines, minhash
from wickstore.llm.common import table
from wickstore.llm.graph import components
from wickstore.llm.queries import ORACLES, QUERIES
from wickstore.session import scratch_root


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(5)
    names = vocabulary(rng)
    texts = list(AWKWARD)
    for _ in range(12):
        base = [rng.choice(names) for _ in range(rng.randint(30, 160))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(names)
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return texts


def test_near_duplicates_match_brute_force(spark, near_texts):
    sets = [shingles(t) for t in near_texts]
    pairs = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    best = groups(range(len(sets)), pairs)
    got = minhash.near_duplicates(documents(spark, near_texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        n: (len(s), best[n], best[n] == n) for n, s in enumerate(sets)
    }
    assert len(got) == len(sets)


@pytest.mark.parametrize("nearest", [3, 1])
def test_variants_connect_through_their_original_only(spark, monkeypatch, nearest):
    """Copies that reach the threshold with one text but not with each other, in several blocks."""
    rng = random.Random(9)
    base = [f"w{n}" for n in range(120)]
    texts = []
    for n in range(60):
        copy = list(base)
        copy[(2 * n) % 120] = f"new{n}"
        texts.append((n + 1, " ".join(copy)))
    texts.append((100, " ".join(base)))
    rng.shuffle(texts)
    for name, size in (("BLOCK", 16), ("FEW", 4), ("SETS", 16), ("COLUMNS", 32)):
        monkeypatch.setattr(minhash, name, size)
    got = minhash.near_duplicates(documents(spark, texts), nearest=nearest).collect()
    assert {r.component_id for r in got} == {1}
    assert [r.doc_id for r in got if r.kept] == [1]


def test_classes_without_an_id_are_linked(spark):
    """Near copies of which one has no id: the class of the other joins them, whatever its rows are called."""
    base = [f"w{n}" for n in range(200)]
    near, other = " ".join([*base[:150], "x", *base[151:]]), " ".join(f"z{n}" for n in range(50))
    rows = [(5, " ".join(base)), (None, near), (None, near), (None, other), (None, None), (9, " ".join([*base[:20], "y", *base[21:]]))]
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in got if r.n_shingles == 196) == [
        (False, 196, 5), (False, 196, 5), (True, 196, 5), (True, 196, 5),
    ]
    assert [r.component_id for r in got if r.n_shingles != 196] == [None, None]


def test_shared_counts():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (5, 90, 200, 1, 60)]
    got = minhash.shared_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_representatives_keep_one_of_each_group(spark):
    text = "a b c d e f g h i j"
    rows = [(4, text), (2, text.upper()), (2, text.upper()), (7, None), (None, text), (9, "other words altogether here now")]
    docs = documents(spark, rows)
    kept = minhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (True, 2), (True, 7), (True, 9),
    ]


def test_minima_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    rows = minhash.minima([values[:2000], values[500:2500]])
    packed = minhash.packed(rows)
    assert abs(minhash.estimates(packed[0], packed[1:])[0] - 1500 / 2500) < 0.15
    assert minhash.estimates(packed[0], packed[:1])[0] == 1


def test_components_of_chain_star_and_loop(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, 100 + n) for n in range(1, 30)] + [(500, 500), (7, None)]
    got = components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()
    want = groups({a for a, b in links} | {b for a, b in links if b is not None}, [p for p in links if p[1] is not None])
    assert {r.node: r.component for r in got} == want


def test_lines_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "LEAST_CHARS", 8)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 25))).strip() for _ in range(30)]

    def changed(text, k):
        letters = list(text)
        for _ in range(k):
            n = rng.randrange(len(letters))
            letters[n : n + rng.randint(0, 1)] = rng.choice(["", "a", "é", "bb"])
        return "".join(letters)

    texts = list(AWKWARD)
    for _ in range(60):
        texts.append("\n".join(changed(rng.choice(base), rng.randint(0, 4)) for _ in range(rng.randint(1, 5))))
    places = [
        (d, n, line)
        for d, t in enumerate(texts)
        for n, raw in enumerate((t or "").split("\n"))
        if len(line := raw.strip(" \t\v\f\r")) >= 8
    ]
    kinds = sorted({p[2] for p in places})
    links = [
        (a, b) for i, a in enumerate(kinds) for b in kinds[:i] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2
    ]
    first = {}
    for d, n, line in places:
        first.setdefault(line, (d, n))
    best = groups([first[k] for k in kinds], [(first[a], first[b]) for a, b in links])
    degree = {k: sum(k in pair for pair in links) for k in kinds}
    copies = {k: sum(p[2] == k for p in places) for k in kinds}
    docs = documents(spark, texts)
    got = lines.deduplicated_lines(docs).collect()
    want = {
        (d, n): (*best[first[line]], copies[line], degree[line], best[first[line]] == (d, n)) for d, n, line in places
    }
    assert len(got) == len(want)
    assert {
        (r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_copies, r.n_links, r.kept) for r in got
    } == want
    assert sum(degree.values()) > 20

    kept = {r.doc_id: r for r in lines.without_repeated_lines(docs).collect()}
    for d, text in enumerate(texts):
        stays = [n for n in range(len((text or "").split("\n"))) if want.get((d, n), (True,))[-1]]
        left = None if text is None else "\n".join(text.split("\n")[n] for n in stays)
        if left is None or left == text:
            assert kept[d].text == text
        elif left.strip():
            assert (kept[d].text, kept[d].n_chars) == (left, len(left))
        else:
            assert d not in kept


def test_lines_at_the_edges_of_length_classes_match_brute_force(spark):
    """Lines of 20 to 134 characters, edited anywhere, ends and both sides of a length class among them."""
    rng = random.Random(4)

    def changed(text, k):
        letters = list(text)
        for _ in range(k):
            n = rng.choice([0, rng.randrange(len(letters)), len(letters) - 1])
            letters[n : n + rng.randint(0, 1)] = rng.choice(["", "q", "é", "zz"])
        return "".join(letters)

    kinds = []
    for size in (20, 23, 24, 31, 32, 47, 48, 63, 64, 65, 96, 97, 127, 128, 129, 130):
        base = "".join(rng.choice("abcdefé日") for _ in range(size))
        kinds.append([base, *(changed(base, rng.randint(1, 3)) for _ in range(9))])
    texts = [line for group in kinds for line in dict.fromkeys(group) if len(line) >= 20]
    degree = {
        n: sum(abs(len(a) - len(b)) <= 2 and n != m and edits(a, b) <= 2 for m, b in enumerate(texts))
        for n, a in enumerate(texts)
    }
    got = lines.deduplicated_lines(documents(spark, texts)).collect()
    assert {r.doc_id: r.n_links for r in got} == degree
    assert sum(degree.values()) > 300


def test_letter_counts_differ_as_counted(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [tuple("".join(rng.choice("eett hnq,") for _ in range(rng.randint(0, 90))) for _ in "ab") for _ in range(60)]

    def gap(a, b):
        gaps = [(a.count(c) - b.count(c)) % 16 for c in lines.LETTERS]
        return sum(min(g, 16 - g) for g in gaps)

    sides = [
        spark.createDataFrame(list(enumerate(side)), "n int, line string").select("n", lines._letters().alias(name))
        for side, name in zip(zip(*rows), "ab")
    ]
    got = sides[0].join(sides[1], "n").select("n", lines._apart(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r.n: r.d for r in got} == {n: gap(a, b) for n, (a, b) in enumerate(rows)}


def test_lines_without_a_partner_cost_little_disk(spark, monkeypatch):
    """Copies and shuffle files after each write of a copy, by the text's size: texts that meet no other stay unwritten."""
    from pyspark.sql.readwriter import DataFrameWriter

    rng = random.Random(2)
    texts = ["\n".join(rng.randbytes(150).hex() for _ in range(20)) for _ in range(400)]
    docs = documents(spark, texts).repartition(4)
    docs, path = lines.kept_copy(docs, "docs")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    root = Path(scratch_root(spark).removeprefix("file:"))

    def used():
        shuffled = disk.getAllFiles().toSeq()
        return sum(f.stat().st_size for f in root.rglob("*") if f.is_file()) + sum(
            shuffled.apply(n).length() for n in range(shuffled.size())
        )

    before, seen, write = used(), [], DataFrameWriter.parquet

    def watched(self, *args, **options):
        write(self, *args, **options)
        seen.append(used() - before)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    assert lines.deduplicated_lines(docs).filter("kept").count() == 8000
    assert 0 < max(seen) < sum(map(len, texts))
    lines.drop_copy(spark, path)


def test_short_lines_are_grouped_when_equal(spark, tmp_path):
    rows = [(1, "Home\n\nShare\nthis line is long enough here"), (2, " Home \nHomes\nthis line is long enough, here"), (3, "Home")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): r for r in QUERIES["op1_line_dedup"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (3, 0)}
    assert {at for at, r in got.items() if not r.kept} == {(2, 0), (2, 2), (3, 0)}
    assert [(got[2, n].n_copies, got[2, n].n_links) for n in range(3)] == [(3, 0), (1, 0), (1, 1)]
    left = corpus_pipeline.line_dedup(spark, documents(spark, rows), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in left} == {1: rows[0][1], 2: "Homes"}


def test_band_distance_matches_full_table(spark):
    rng = random.Random(8)
    for k in (1, 3):
        rows = []
        for _ in range(150):
            a = "".join(rng.choice("abé") for _ in range(rng.randint(k + 1, 20)))
            b = "".join(rng.choice("abé") if rng.random() < 0.2 else c for c in a) + "a" * rng.randint(0, k)
            rows.append((a, b, edits(a, b)))
        frame = spark.createDataFrame(rows, "a string, b string, d int")
        from pyspark.sql import functions as F

        got = frame.select("d", lines.within_edits(F.col("a"), F.col("b"), k).alias("near")).collect()
        assert all(r.near == (r.d <= k) for r in got)


def test_decontamination_matches_sql(spark, sf_dir):
    with duckdb.connect() as duck:
        for name in ("documents", "benchmark"):
            duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        want = duck.execute(ORACLES["op6_decontaminate"]).fetchall()
    got = QUERIES["op6_decontaminate"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    docs = table(spark, sf_dir, "documents")
    clean = decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {
        r.doc_id for r in clean.select("doc_id").collect()
    } == {w[0] for w in want}


def test_decontamination_in_blocks_and_edge_cases(spark, monkeypatch):
    passage = "the quick brown fox jumps over the lazy dog today"
    items = spark.createDataFrame(
        [(1, passage), (1, passage), (2, None), (3, "too few words"), (None, passage), (5, "quite another set of words to look for")],
        "item_id long, text string",
    )
    texts = [*AWKWARD, f"before, {passage.upper()}! after " + "z " * 400, "the quick brown fox jumps", passage[:30]]
    docs = documents(spark, texts)
    want = [(len(AWKWARD), 1, 6, 6)] * 2
    for bound in (1_000_000, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", bound)
        got = decontaminate.contained_items(docs, items).drop("containment").collect()
        assert sorted(map(tuple, got)) == want
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, items).count() == len(texts) - 1


def test_chunks_resist_insertions_and_report_passages(spark):
    rng = random.Random(2)
    names = vocabulary(rng, 3000)
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    passage = say(70)
    texts = [say(200) for _ in range(30)]
    planted = [(30, say(40) + " " + passage + " " + say(30)), (31, passage), (32, say(7) + passage + "!" + say(90))]
    rows = [*enumerate(texts), *planted, (40, texts[3]), (41, None), (42, "")]
    got = chunks.repeated_passages(documents(spark, rows)).collect()
    assert {r.doc_id for r in got} == {30, 31, 32, 3, 40}
    for r in got:
        text = dict(rows)[r.doc_id].encode()
        found = text[r.start : r.start + r.length]
        assert r.length >= 160 and (found in passage.encode() or found in texts[3].encode())
        assert r.is_first == (r.first_doc_id == r.doc_id)
    assert {r.doc_id for r in got if r.is_first} == {r.first_doc_id for r in got} == {30, 3}


def test_a_copied_document_holds_a_passage_of_another(spark):
    rng = random.Random(12)
    names = vocabulary(rng, 3000)
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    passage, before, after = say(200), say(150), say(150)
    whole = f"{before} {passage} {after}"
    twice = say(200)
    rows = [(3, f"{say(60)} {passage} {say(60)}"), (7, whole), (9, whole), (11, f"{twice} {say(60)} {twice}")]
    got = chunks.repeated_passages(documents(spark, rows)).collect()

    def covered(doc, is_first, part, last=False):
        text = dict(rows)[doc].encode()
        at = (text.rindex if last else text.index)(part.encode())
        bits = [
            any(r.start <= n < r.start + r.length for r in got if r.doc_id == doc and r.is_first == is_first)
            for n in range(at, at + len(part))
        ]
        return sum(bits) / len(bits)

    assert covered(3, True, passage) > 0.6 and covered(3, False, passage) == 0
    assert covered(7, False, passage) > 0.6 and covered(7, True, passage) < 0.2
    assert min(covered(7, True, before), covered(7, True, after)) > 0.6
    assert covered(9, False, whole) > 0.9 and covered(9, True, whole) == 0
    assert covered(11, True, twice) > 0.6 and covered(11, False, twice, last=True) > 0.6
    assert covered(11, False, twice) == covered(11, True, twice, last=True) == 0


def test_passages_of_51_words_are_found_whole(spark):
    rng = random.Random(51)
    names = vocabulary(rng, 3000)
    say = lambda n: " ".join(rng.choice(names) for _ in range(n))
    planted = [say(51) for _ in range(500)]
    rows = [*enumerate(f"{say(9)} {p} {say(9)}" for p in planted), *enumerate((f"{say(7)} {p} {say(7)}" for p in planted), 1000)]
    got = chunks.repeated_passages(documents(spark, rows)).collect()
    texts, found = dict(rows), {}
    for r in got:
        found.setdefault(r.doc_id, []).append((texts[r.doc_id].encode()[r.start : r.start + r.length].decode(), r.is_first))
    whole = sum(any(p in text and not first for text, first in found.get(1000 + n, [])) for n, p in enumerate(planted))
    kept = sum(any(p in text and first for text, first in found.get(n, [])) for n, p in enumerate(planted))
    assert (whole, kept) == (500, 500)


def test_passages_with_short_words_and_periods(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    short = say(60)
    rows = [(1, f"{say(30)} {short} {say(30)}"), (2, f"{say(41)} {short} {say(40)}"), (3, "word " * 400), (4, "x" * 5000), (4, "x" * 5000)]
    got = chunks.repeated_passages(documents(spark, rows)).collect()
    assert any(r.doc_id == 2 and not r.is_first and r.length >= len(short) for r in got)
    assert sum(r.length for r in got if r.doc_id == 3 and not r.is_first) > 1800


def test_cuts_cover_the_text():
    import numpy as np

    rng = np.random.default_rng(4)
    for data in (rng.integers(97, 123, 5000, dtype=np.uint8), np.full(10_000, 97, np.uint8), np.zeros(1, np.uint8)):
        ends = chunks.cuts(data, 32, 300)
        assert ends[-1] == len(data) and (np.diff(ends, prepend=0) > 0).all()
        assert np.diff(ends, prepend=0).max() <= 300
    text = rng.integers(97, 123, 3000, dtype=np.uint8)
    shifted = np.concatenate([text[:10], text])
    assert set(chunks.cuts(text, 32, 4096)[2:]) <= set(chunks.cuts(shifted, 32, 4096) - 10)


def test_empty_tables(spark):
    docs = documents(spark, ["x"]).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert lines.deduplicated_lines(docs).count() == 0
    assert lines.without_repeated_lines(docs).count() == 0
    assert decontaminate.contained_items(docs, items).count() == 0
    assert chunks.repeated_passages(docs).count() == 0


def test_extension_reaches_over_a_long_chunk():
    around = b"ab " * 900
    text = b"q " + around + b"middle" + b" cd" * 900 + b" z"
    begin, end = 2 + len(around), 2 + len(around) + 6
    assert chunks.extended(text, begin, end, b"r " + around, b" cd" * 900 + b"!") == (2, end + 2700)
    assert chunks.extended(text, begin, end, b"", b"") == (begin, end)
