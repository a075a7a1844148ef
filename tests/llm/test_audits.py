"""Whitening, URL rules and the filter audit against plain versions."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, WORD, documents
from wickstore.llm import audit, url_rules, whitening
from wickstore.llm.common import kept_copy
from wickstore.llm.queries import ORACLES, QUERIES, URL_RULES
from wickstore.llm.text import slices

# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, n int, deviation string"


def vectors(spark, rows):
    given = [r if isinstance(r, tuple) else (n, r) for n, r in enumerate(rows)]
    return spark.createDataFrame([(i, None if v is None else list(v), 7, "x") for i, v in given], VECTORS)


def integers(rows):
    width = max(len(r) for r in rows)
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in (*r, *[0.0] * (width - len(r)))] for r in rows]


def check_whitened(got, ids, rows, wanted=8):
    """Every promise of the operator on ``rows``, the vectors that count, by exact sums and a dense solver."""
    x = integers(rows)
    n = len(x)
    total = [sum(c) for c in zip(*x)]
    exact = [[n * v - s for v, s in zip(r, total)] for r in x]
    gaps = np.array([[float(v) for v in r] for r in exact]) / n
    values, axes = np.linalg.eigh(gaps.T @ gaps / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(wanted, int((values > values.sum() * 1e-15).sum()))
    assert len(got) == n * k
    by_component = defaultdict(list)
    for r in got:
        by_component[r.component].append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    want = Counter((i, sum(v * v for v in r)) for i, r in zip(ids, exact))
    for own in by_component.values():
        assert Counter((r.vec_id, r.deviation) for r in own) == want
    for c, own in by_component.items():
        assert math.isclose(own[0].explained, values[c - 1] / values.sum(), rel_tol=1e-9)
    if len(set(ids)) == n:
        place = {i: p for p, i in enumerate(ids)}
        w = np.zeros((n, k))
        for r in got:
            w[place[r.vec_id], r.component - 1] = r.whitened
        assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-10
        for c in range(k):
            near = [values[c] - values[o] for o in range(len(values)) if o != c]
            if min(map(abs, near), default=1.0) > 1e-3 * values[0]:
                plain = gaps @ axes[:, c] / math.sqrt(values[c])
                assert min(np.abs(w[:, c] - plain).max(), np.abs(w[:, c] + plain).max()) < 1e-8


def test_whitening_of_given_table(spark, sf_dir):
    got = QUERIES["op11_whitening"](spark, sf_dir).collect()
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf_dir}/embeddings.parquet'").fetchall()
    check_whitened(got, [i for i, _ in table], [v for _, v in table])


def test_whitening_stops_early_in_wide_tables(spark):
    """A few strong directions of many dimensions are found in fewer steps than there are dimensions."""
    random_ = np.random.default_rng(5)
    rows = random_.standard_normal((300, 12)) * 2.0 ** -np.arange(12) @ random_.standard_normal((12, 120))
    rows = (rows + 1e-3 * random_.standard_normal(rows.shape)).astype(np.float32).tolist()
    passes = []
    plain, whitening.summed = whitening.summed, lambda *a: passes.append(1) or plain(*a)
    try:
        got = whitening.whitened(vectors(spark, rows)).collect()
    finally:
        whitening.summed = plain
    assert len(passes) < 100
    check_whitened(got, range(300), rows)


def test_equal_deviations_are_all_found(spark):
    """Plus and minus each axis: every direction has the same deviation; one start alone would find one."""
    rows = [[s * (n == m) for m in range(10)] for n in range(10) for s in (1.0, -1.0)]
    at = whitening.centre(vectors(spark, rows), "embedding")
    trace, found = whitening.components(vectors(spark, rows), "embedding", at, 8)
    axes = np.array([v for _, v in found])
    assert len(found) == 8 and np.abs(axes @ axes.T - np.eye(8)).max() < 1e-12
    assert all(math.isclose(share, 0.1, rel_tol=1e-12) for share, _ in found)
    check_whitened(whitening.whitened(vectors(spark, rows)).collect(), range(20), rows)


def test_awkward_vectors(spark):
    whole = [[0.5, 0.25, -1.0], [0.1, 0.9, 2.0], [0.7, -0.3, 0.0], [0.7, -0.3, 0.0], [3.0, 1.0]]
    bad = [None, [None, 1.0, 2.0], [math.nan, 1.0, 0.0], [math.inf, 0.0, 0.0], [3e38, 0.0, 0.0]]
    rows = [(n, v) for n, v in enumerate(whole + bad)] + [(None, [1.0, 1.0, 1.0]), (2, [0.7, -0.3, 0.0]), (11, [])]
    got = whitening.whitened(vectors(spark, rows)).collect()
    kept = [r for r in rows if r[1] in whole or r[0] in (None, 11)]
    check_whitened(got, [i for i, _ in kept], [v for _, v in kept])
    for none in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None], [[]]):
        empty = whitening.whitened(vectors(spark, none))
        assert empty.columns[:3] == ["vec_id", "component", "n"] and not empty.collect()


def test_deviations_beyond_64_bits():
    y = np.array([[2**40, -(2**40)], [0, 0], [1, 5]])
    at = whitening.Centre(3, *[np.array(v) for v in zip(*[divmod(int(c), 3) for c in y.sum(axis=0)])])
    s = [int(c) for c in y.sum(axis=0)]
    assert at.deviations(y) == [sum((3 * int(v) - t) ** 2 for v, t in zip(r, s)) for r in y]
    assert whitening._wide_sum(np.array([2**61] * 9 + [-5])) == 9 * 2**61 - 5


# ---------------------------------------------------------------- URL rules

PAGES = "page_id long, url string, html string, row string, host int, rule string"


def pages(spark, urls):
    rows = [u if isinstance(u, tuple) else (n, u) for n, u in enumerate(urls)]
    return spark.createDataFrame([(i, u, "<p>", "r", 1, "s") for i, u in rows], PAGES)


def plain_verdict(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def check_judged(spark, urls, rules, default="allow", plain_rules=None):
    given = pages(spark, urls)
    table = spark.createDataFrame([(*r, "e") for r in rules], "host string, path string, verdict string, page_id string")
    got = url_rules.judged(given, table, default).collect()
    rows = [(r.page_id, r.url) for r in given.collect()]
    want = Counter((i, *plain_verdict(u, plain_rules or rules, default)) for i, u in rows)
    assert Counter(map(tuple, got)) == want


def test_rules_on_awkward_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "https://ORG", "https://org/", "https://a.ORG/es/?q=/en/1#x", "ftp://org?x/",
        "http://example.org/en/1", "http://example.org/en/100/x", "http://notexample.org/en/1", "http://x.example.org/es/é",
        "http://com/fr/", "http://x..com/de/y", "http://com.", "http://.com/fr/", "http://user@b.com:80/de/", "http://b.com/de/",
        "a://b.com/fr/://c.com/de/", "http://日本.org/ü", "http://org/" + "x" * 300_000, "http://" + "a." * 3000 + "org/q",
        (5, "http://org/es/"), (5, "http://org/es/"), (None, "http://org/es/"), (None, "http://org/es/"),
    ]
    check_judged(spark, urls, URL_RULES)
    check_judged(spark, urls, URL_RULES, "block")
    check_judged(spark, urls, [])
    check_judged(spark, [], URL_RULES)


def test_nested_and_repeated_rules(spark):
    rules = [
        ("", "", "block"), ("org", "", "allow"), ("org", "/a", "block"), ("org", "/a/b", "allow"), ("b.org", "/a", "allow"),
        ("b.org", "/a/b/c", "block"), ("a.b.org", "/", "allow"), ("a.b.org", "/a/b/c/d", "block"), ("c.org", "/a/b", "block"),
    ]
    useless = [(None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("org", "x", "block"), ("o/rg", "/", "block")]
    doubled = [("org", "/a", "allow"), ("org", "/a", "block")]
    hosts = ["org", "b.org", "a.b.org", "x.a.b.org", "c.org", "xb.org", "net", "borg"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/bc", "/a/b/c", "/a/b/c/d/e", "/b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    check_judged(spark, urls, rules + useless + doubled, "none", rules)


def test_many_rules_over_many_ranges(spark):
    """Random nested rules and a host with half of the URLs: ranges cut through open rules everywhere."""
    random.seed(3)
    label = lambda: random.choice("ab")

    def place(most):
        return ".".join(label() for _ in range(random.randint(1, most))), "".join(
            f"/{label()}" for _ in range(random.randint(0, most))
        )

    rules = list({place(4): random.choice(["allow", "block"]) for _ in range(120)}.items())
    urls = [f"http://{h}{p}" for h, p in (place(7) for _ in range(1500))]
    urls += [f"http://a.a{place(6)[1]}" for _ in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check_judged(spark, urls, [(h, p, v) for (h, p), v in rules])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rules_run_without_python(spark, sf_dir):
    plan = QUERIES["op12_url_rules"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)


# ------------------------------------------------------------- filter audit

LABELS = "doc_id long, quality int, toxic int, text string, part string"


def plain_audit(rows, labels):
    """``rows`` of (doc_id, text, source): every order run as a filter chain."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))

    def fails(i, text):
        text = text or ""
        w = WORD.findall(text)
        return {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > lowest[text],
        }

    parts = defaultdict(list)
    for i, text, source in rows:
        parts[source or ""].append((i, {f for f, bad in fails(i, text).items() if bad}))
    out, shapley = {}, Counter()
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = docs
            for step, f in enumerate(order, 1):
                gone = [(i, bad) for i, bad in alive if f in bad]
                alive = [(i, bad) for i, bad in alive if f not in bad]
                shapley[part, f] += len(gone)
                out[part, order, step] = (
                    len(alive),
                    len(gone),
                    sum(f in bad for _, bad in docs) - len(gone),
                    sum(bad == {f} for _, bad in docs),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                )
    return {(p, o, s): (*row, shapley[p, o[s - 1]]) for (p, o, s), row in out.items()}


def check_audit(spark, rows, labels):
    schema = "doc_id long, text string, lang string, source string, n_chars long, part string, mask string"
    docs = spark.createDataFrame([(i, t, "en", s, 3, "p", "m") for i, t, s in rows], schema)
    told = spark.createDataFrame([(*x, "t", "p") for x in labels], LABELS)
    got = audit.audited(docs, told)
    result = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}
    assert got.count() == len(result)
    assert result == plain_audit(rows, labels)


def test_audit_of_awkward_texts(spark):
    random.seed(4)
    pool = [f"word{n}" for n in range(90)]
    texts = [*AWKWARD, "#", "$ money", "UPPER CASE TEXT", "日本語 " * 60, "x " * (1 << 20), "É|", "w" * 2_000_000]
    texts += [" ".join(random.choices(pool, k=random.randint(30, 200))) for _ in range(40)]
    texts += [(t or "") + random.choice(["", "", " #", " " + "ABC" * 200]) for t in texts]
    rows = [(n * 7 % 101, t, random.choice(["a", "b", None, ""])) for n, t in enumerate(texts)]
    rows += [(random.choice([None, 3, 500, 3]), random.choice(texts), "a") for _ in range(60)]
    rows += [(n, "the same text", random.choice("abc")) for n in range(1000, 1200)]
    labels = [(n, random.randint(0, 1), random.randint(0, 1)) for n in range(0, 1200, 3)]
    labels += [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None), (99_999, 1, 1)]
    check_audit(spark, rows, labels)
    check_audit(spark, rows[:5], [])
    check_audit(spark, [], labels)


@pytest.mark.parametrize("size", [1 << 25, 60])
def test_matrix_holds_every_word(spark, monkeypatch, size):
    monkeypatch.setattr(audit, "DICTIONARY_BYTES", size)
    monkeypatch.setattr(audit, "slices", lambda batch: slices(batch, limit=30))
    texts = [*AWKWARD, "same words here as elsewhere", "b a b"]
    docs = documents(spark, texts).repartition(5)
    local, _ = kept_copy(audit.blocks(docs), "blocks")
    numbers, _ = kept_copy(audit.word_ids(local), "words")
    ids = [(r.word, r.id) for r in audit.vocabulary(local, numbers).collect()]
    spelled = {i: w for w, i in ids}
    assert len(ids) == len(spelled) == len(set(w for w, _ in ids))
    assert set(w for w, _ in ids) == {w for t in texts for w in WORD.findall(t or "")}
    found = Counter()
    for row in audit.sparse_shards(local, numbers).collect():
        starts = np.frombuffer(row.starts, audit.STARTS)
        columns = np.frombuffer(row.columns, audit.COLUMNS).tolist()
        counts = np.frombuffer(row.counts, audit.COUNTS).tolist()
        for n, i in enumerate(row.doc_id):
            a, b = starts[n : n + 2]
            assert columns[a:b] == sorted(columns[a:b])
            found[i, frozenset((spelled[c], k) for c, k in zip(columns[a:b], counts[a:b]))] += 1
    assert found == Counter((i, frozenset(Counter(WORD.findall(t or "")).items())) for i, t in enumerate(texts))


@pytest.mark.parametrize("name", ["op12_url_rules", "op13_filter_audit"])
def test_queries_match_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = connection.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    want = Counter(result.fetchall())
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == want
