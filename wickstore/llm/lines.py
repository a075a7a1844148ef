"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Lines are put into classes of like length, and a line is cut into ``edits + 1`` segments that its class fixes, the
first ones counted from its start and the last ones from its end. Two lines within ``edits`` edits share a segment of
the shorter one, at most a few characters away; each line therefore probes the segments of the classes that it or a
slightly shorter line has, at the few places where they can stand. Most segments stand in one line only, which an
aggregate of the keys shows; the lines that are left meet in a join, and pairs that meet are verified by banded
bit-parallel edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy, rows_with, settled_copy
from wickstore.llm.graph import components

EDITS = 2
#: Lines with fewer characters are only compared exactly: within a few edits they are not the same line.
LEAST_CHARS = 20
BLANK = " \t\v\f\r"
#: Characters whose counts keep distant lines apart before their texts are fetched; any fifteen will do.
LETTERS = "ethnoarisdlcu ,"
#: Parts of a line that are compared in place before the edit distance is computed.
PARTS = 8
#: Lines that a document may have; a position is doc_id * LINES + line number.
LINES = 1_000_000_000


def _padded(line: str) -> Column:
    """Whether a blank stands at either end; trimming costs far more than this test."""
    found = F.lit(False)
    for blank in BLANK:
        found = found | F.startswith(line, F.lit(blank)) | F.endswith(line, F.lit(blank))
    return found


def _position() -> Column:
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).cast("decimal(38,0)")
    return (number * LINES + F.col("line_no")).cast("decimal(38,0)")


def lines_of(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, line_no, line): trimmed lines of ``LEAST_CHARS`` characters; if ``short``, of any but none."""
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .withColumn("line", F.when(_padded("line"), F.btrim("line", F.lit(BLANK))).otherwise(F.col("line")))
        .filter(F.char_length("line") >= (1 if short else LEAST_CHARS))
    )


def _class(length: Column) -> Column:
    """The length with all but its first three bits zero: a line of the class has at least so many characters."""
    spare = F.greatest(F.lit(0), F.floor(F.log2(length)).cast("int") - 2)
    return F.call_function("shiftleft", F.call_function("shiftright", length, spare), spare)


def _key(size: Column, segment: int, shift: int, edits: int) -> Column:
    """Hash of a segment of the class, ``shift`` characters from its place in the line."""
    if segment <= edits - segment:
        first = size * segment + (1 + shift)
    else:
        first = F.col("chars") - size * (edits + 1 - segment) + (1 + shift)
    return F.xxhash64("class", F.lit(segment), F.substring(F.col("line"), first, size))


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (with ``line``) with ``own`` and ``keys``, a row for each class that a line looks into.

    The row of the line's own class is ``own``; its first ``edits + 1`` keys are those of its segments, the others
    places where the segments of another line may stand. Only lines of ``LEAST_CHARS`` characters have keys.
    """
    length, spare = F.col("chars"), range(edits + 1)
    classes = F.array_distinct(F.array(*[_class(length - shorter) for shorter in spare]))
    classes = F.when(length >= LEAST_CHARS, classes).otherwise(F.array(F.lit(0)))
    size = F.floor(F.col("class") / (edits + 1)).cast("int")
    # An untouched segment has as many edits before it as segments; the others stand behind it.
    reach = [min(s, edits - s) for s in spare]
    places = [(s, 0) for s in spare] + [(s, n) for s in spare for n in range(-reach[s], reach[s] + 1) if n]
    keys = F.array(*[_key(F.col("size"), s, n, edits) for s, n in places])
    return (
        lines.withColumn("chars", F.char_length("line"))
        .select("*", F.posexplode(classes).alias("other", "class"))
        .withColumn("size", size)
        .withColumn("keys", F.when(length >= LEAST_CHARS, keys))
        .withColumn("own", F.col("other") == 0)
        .drop("other", "class", "size")
    )


def _letters() -> Column:
    """How often each of ``LETTERS`` stands in the line, modulo 16, four bits each."""
    counted = F.lit(0).cast("long")
    for n, letter in enumerate(LETTERS):
        count = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(letter)))
        counted = counted.bitwiseOR(F.shiftleft(count.cast("long").bitwiseAND(F.lit(15)), 4 * n))
    return counted


def _apart(a: Column, b: Column) -> Column:
    """At most the sum of the differences of two letter counts; an edit adds two at most. All counts at once."""
    digits = len(LETTERS)
    high, low = (F.lit(int(d * digits, 16)).cast("long") for d in ("8", "7"))
    bits = lambda text: F.lit(int(text, 16)).cast("long")
    gap = a.bitwiseOR(high) - b.bitwiseAND(low)
    gap = gap.bitwiseXOR(a.bitwiseXOR(b).bitwiseXOR(high).bitwiseAND(high))
    over = F.shiftright(gap.bitwiseAND(high), 3)
    gap = gap.bitwiseXOR(over * 15) + over
    for mask, width in (("0f" * 8, 4), ("00ff" * 4, 8), ("0000ffff" * 2, 16), ("00000000ffffffff", 32)):
        gap = gap.bitwiseAND(bits(mask)) + F.shiftright(gap, width).bitwiseAND(bits(mask))
    return gap


def _parts_alike(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` of the parts of ``a`` stand in ``b``, at most ``edits`` characters away.

    An edit spoils one part and moves the rest by one, so lines within ``edits`` edits always pass.
    """
    size = F.floor(F.char_length(a) / PARTS).cast("int")
    alike = F.lit(0)
    for part in range(PARTS):
        piece = F.substring(a, size * part + 1, size)
        first = F.greatest(size * part + 1 - edits, F.lit(1))
        around = F.substring(b, first, size * part + 1 + edits + size - first)
        alike = alike + F.contains(around, piece).cast("int")
    return alike >= PARTS - edits


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are at most ``edits`` edits apart; ``a`` is no longer than ``b`` and both are longer
    than ``edits``.

    One column of the distance table is kept as bits of a band of ``2 * edits + 1`` cells around its diagonal:
    where the distance rises by one from the cell above (``vp``) and where it falls (``vn``). The distance is
    followed down the lowest diagonal of the band to the last row and then along it.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    bits = lambda n: F.lit(n).cast("long")
    x, y = F.split(a, ""), F.split(b, "")
    m, n = F.char_length(a), F.char_length(b)
    padding = F.array_repeat(F.lit(""), edits)
    padded = F.concat(padding, x, F.array_repeat(F.lit(""), edits * 2 + 1))

    def match(chars: Column, column: Column, letter: Column) -> Column:
        found = bits(0)
        for j in range(width):
            same = F.get(chars, column + (j - 1)).eqNullSafe(letter)
            found = found.bitwiseOR(F.when(same, bits(1 << j)).otherwise(bits(0)))
        return found

    columns = _let(
        padded,
        lambda chars: F.transform(
            y, lambda letter, i: F.struct((i + 1).alias("c"), match(chars, i + 1, letter).alias("x"))
        ),
    )

    def step(state: Column, column: Column) -> Column:
        vp, vn, met = state["vp"], state["vn"], column["x"]

        def after(d0: Column) -> Column:
            def horizontal(h: Column) -> Column:
                hp, hn = h["hp"], h["hn"]
                down = F.shiftright(d0, 1)
                falling = column["c"] > m - edits
                place = F.call_function("shiftright", bits(top), (column["c"] - (m - edits)).cast("int"))
                flat = F.when(hp.bitwiseAND(place) != 0, 1).when(hn.bitwiseAND(place) != 0, -1).otherwise(0)
                slant = F.when(d0.bitwiseAND(bits(top)) != 0, 0).otherwise(1)
                return F.struct(
                    hn.bitwiseOR(bits(full).bitwiseAND(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (state["score"] + F.when(falling, flat).otherwise(slant)).alias("score"),
                )

            hp = vn.bitwiseOR(bits(full).bitwiseAND(F.bitwise_not(d0.bitwiseOR(vp))))
            return _let(F.struct(hp.alias("hp"), d0.bitwiseAND(vp).alias("hn")), horizontal)

        carried = (met.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        return _let(carried.bitwiseOR(met).bitwiseOR(vn).bitwiseAND(bits(full)), after)

    start = F.struct(
        bits(((1 << (edits + 1)) - 1) << edits).alias("vp"), bits(0).alias("vn"), F.lit(edits).alias("score")
    )
    return (n - m <= edits) & (F.aggregate(columns, start, step, lambda state: state["score"]) <= edits)


def _trimmed(pair: Column, edits: int) -> Column:
    """``x`` and ``y`` without the characters they begin with alike, backwards; ``edits + 1`` of ``x`` stay."""
    x, y = pair["x"], pair["y"]

    def longer(same: Column, step: Column) -> Column:
        alike = F.substring(x, same + 1, step) == F.substring(y, same + 1, step)
        fits = same + step < F.char_length(x) - edits
        return F.when(fits & alike, same + step).otherwise(same)

    same = F.aggregate(F.array(*[F.lit(1 << n) for n in range(15, -1, -1)]), F.lit(0), longer)
    rest = lambda text, n: F.reverse(F.substring(text, n + 1, F.char_length(text)))
    return _let(same, lambda n: F.struct(rest(x, n).alias("x"), rest(y, n).alias("y")))


def _verified(x: Column, y: Column, edits: int) -> Column:
    """``within_edits`` of what two texts don't begin and end with alike."""
    pair = _trimmed(F.struct(x.alias("x"), y.alias("y")), edits)
    pair = _let(pair, lambda p: _trimmed(p, edits))
    return _let(pair, lambda p: within_edits(p["x"], p["y"], edits))


def _shared_keys(places: DataFrame, edits: int) -> tuple[DataFrame, str]:
    """(key, id, indexed): the keys of several lines, each line once; ``indexed``: it is of the line's segments."""
    spark = places.sparkSession
    indexed = F.col("own") & (F.col("at") <= edits)
    rows = places.select(F.col("h1").alias("id"), "own", F.posexplode("keys").alias("at", "key"))
    several = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last")
    several, path = settled_copy(several.select("key"), "several")
    rows = rows_with(rows.select("key", "id", indexed.alias("indexed")), several, "key", several.count())
    shared, shared_path = settled_copy(rows.distinct(), "shared")
    drop_copy(spark, path)
    return shared, shared_path


def linked_lines(docs: DataFrame, places: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(a, b, p, q): hashes and first positions of different lines within ``edits`` edits; (h1, h2, position) of these
    lines and others.

    Lines that share a segment meet in a sort-merge join, which Spark splits where one segment is common;
    lengths and letter counts that two lines within reach cannot differ in by much keep the others from
    becoming rows.
    """
    spark = docs.sparkSession
    shared, shared_path = _shared_keys(places, edits)
    ids, ids_path = settled_copy(shared.select("id").distinct(), "ids")
    lines = lines_of(docs).withColumn("id", F.xxhash64("line"))
    lines = rows_with(lines, ids, "id", ids.count()).groupBy("id", "line").agg(F.min(_position()).alias("position"))
    texts, texts_path = settled_copy(
        lines.withColumn("letters", _letters()).withColumn("chars", F.char_length("line")), "texts"
    )
    met, met_path = settled_copy(shared.join(texts.select("id", "letters", "chars"), "id"), "met")
    left = met.filter("indexed").drop("indexed")
    near = _apart(F.col("letters"), F.col("q_letters")) <= 2 * edits
    like = F.abs(F.col("chars") - F.col("q_chars")) <= edits
    sides = []
    for probes, order in (
        (left, F.col("id") < F.col("q_id")),
        (met.filter("not indexed"), F.col("id") != F.col("q_id")),
    ):
        named = probes.select("key", *[F.col(c).alias(f"q_{c}") for c in ("id", "letters", "chars")])
        pairs = left.hint("merge").join(named, "key").filter(order & like & near)
        sides.append(pairs.select(F.least("id", "q_id").alias("a"), F.greatest("id", "q_id").alias("b")))
    pairs, path = settled_copy(sides[0].union(sides[1]).distinct(), "pairs")
    x = texts.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("position").alias("p"))
    y = texts.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("position").alias("q"))
    both = pairs.join(x, "a").join(y, "b")
    shorter = F.char_length("x") <= F.char_length("y")
    both = both.select(
        "a", "b", "p", "q", F.when(shorter, F.col("x")).otherwise(F.col("y")).alias("x"),
        F.when(shorter, F.col("y")).otherwise(F.col("x")).alias("y"),
    ).filter(_parts_alike(F.col("x"), F.col("y"), edits))
    verified = _verified(F.col("x"), F.col("y"), edits)
    links, _ = settled_copy(both.filter(verified).select("a", "b", "p", "q"), "links")
    hashes = texts.select(F.col("id").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "position")
    hashes, _ = settled_copy(hashes, "hashes")
    for used in (shared_path, ids_path, texts_path, met_path, path):
        drop_copy(spark, used)
    return links, hashes


def line_classes(docs: DataFrame, edits: int = EDITS, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, n_copies, n_links, number, line): classes of the lines that are repeated or linked; places of all lines.

    Lines are told by two hashes of their trimmed text. ``n_copies`` counts its places, ``n_links`` the
    different lines within ``edits`` edits, ``number`` and ``line`` name the first place of the whole class, by doc_id (null:
    the smallest long) and line number. Places: doc_id, line_no, h1, h2.
    """
    spark = docs.sparkSession
    hashes = F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    rows, _ = settled_copy(keyed(lines_of(docs, short), edits).select("doc_id", "line_no", *hashes, "own", "keys"), "places")
    places = rows.filter("own").select("doc_id", "line_no", "h1", "h2")
    links, found = linked_lines(docs, rows, edits)
    labels = components(links, "p", "q").withColumnRenamed("node", "position")
    ends = links.select(F.col("a").alias("h1")).union(links.select(F.col("b").alias("h1")))
    degrees = ends.groupBy("h1").agg(F.count("*").alias("n_links"))
    linked = found.join(degrees, "h1").join(labels, "position").drop("position")
    repeated = (
        places.groupBy("h1", "h2")
        .agg(F.min(_position()).alias("position"), F.count("*").alias("n_copies"))
        .filter("n_copies > 1")
    )
    first = F.coalesce("component", "position")
    number = F.floor(first / LINES)
    classes = repeated.join(linked, ["h1", "h2"], "full").select(
        "h1", "h2", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        number.cast("long").alias("number"), (first - number * LINES).cast("long").alias("line"),
    )
    classes, _ = settled_copy(classes, "classes")
    return classes, places


def _first_place() -> Column:
    return (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.col("number")) & (F.col("line_no") == F.col("line"))


def deduplicated_lines(docs: DataFrame, edits: int = EDITS, short: bool = False) -> DataFrame:
    """Per line of ``docs`` with at least ``LEAST_CHARS`` characters: its class and whether it stays.

    With ``short``, every line that isn't blank; those below ``LEAST_CHARS`` are grouped with equal ones only.

    Columns: doc_id, line_no (from 0), class_doc_id and class_line_no (the first place of any line of the
    class), n_copies (places of the equal line), n_links (different lines within ``edits`` edits), kept (it is
    that first place). Lines are trimmed of ASCII white space; a class holds the lines that chains of links
    connect. Null and empty texts have no lines. A null doc_id sorts before all others. Rows that repeat an id
    count as the same document, so equal lines at equal places stay together. Further columns are ignored; an
    empty table gives an empty result.
    """
    classes, places = line_classes(docs, edits, short)
    marked = places.join(classes, ["h1", "h2"], "left")
    alone, no_id = F.col("n_copies").isNull(), F.lit(-(2**63))
    return marked.select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.when(alone, F.col("doc_id").cast("long")).otherwise(F.nullif("number", no_id)).alias("class_doc_id"),
        F.when(alone, F.col("line_no").cast("long")).otherwise(F.col("line")).alias("class_line_no"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | _first_place()).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, short: bool = False) -> DataFrame:
    """``docs`` with the lines that ``deduplicated_lines`` does not keep taken out of ``text``.

    ``n_chars`` is counted anew where the table has it. Documents that lose lines and have none but blank ones
    left are dropped; documents that were null, empty or blank before stay as they are.
    """
    classes, places = line_classes(docs, edits, short)
    again = places.join(classes, ["h1", "h2"]).filter(~_first_place())
    gone = again.groupBy("doc_id").agg(
        F.collect_set(F.struct("line_no", F.col("h1"))).alias("_gone")
    ).withColumnRenamed("doc_id", "_id")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    trimmed = F.filter(
        F.split("text", "\n"),
        lambda line, i: ~F.array_contains(
            F.col("_gone"), F.struct(i.alias("line_no"), F.xxhash64(F.btrim(line, F.lit(BLANK))).alias("h1"))
        ),
    )
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(trimmed, "\n"))
    changed = joined.withColumn("text", text).filter(
        "_gone is null or length(btrim(text, ' \\t\\n\\r\\f')) > 0"
    )
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
        )
    return changed.select(*docs.columns)
