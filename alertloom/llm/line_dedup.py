"""Repeated lines, equal up to a few edits, by a segment-partition join in SQL functions only.

Two lines within ``edits`` edits share at least one of ``edits + 1`` even segments,
shifted by a few places.  A line is an index entry under its own segments and probes for
lines of its own length and down to ``edits`` less, at the places that a match
allows.  Keys are hashes of segment number, indexed length and substring; whatever meets
under a key is verified by banded bit-parallel edit distance, whose band of
``2 * edits + 1`` diagonals fits one word.  Before that, marks are compared: an edit changes
the parity of at most two characters and four pairs of characters, so lines whose marks
differ in more bits are too far apart.  Where a crowded key leaves many lines in different classes, the
last step compares their lengths and the parities of their triples of characters, too.

All lines take part that are not blank.  Edits count between lines of at least ``least``
characters (blanks at the ends of a line not counted); a shorter one is only equal to itself,
as few characters leave no room for edits.  Lines linked by edits, directly or through others,
are one class; the first of a class stays: smallest doc_id, then first in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import keyed
from alertloom.llm.linking import linked
from alertloom.session import written

EDITS = 2
LEAST = 20
SMALL_BYTES = 8_000_000
OFTEN = 1000


def is_small(df: DataFrame, width: Column | None = None, most: int = SMALL_BYTES) -> bool:
    """Whether the rows of a written frame, of ``width`` bytes each, have at most ``most`` together."""
    return (df.agg(F.sum(F.lit(32) if width is None else width)).first()[0] or 0) <= most


def small(df: DataFrame, width: Column | None = None) -> DataFrame:
    """A written frame, to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df, width) else df


def text_lines(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, place, line, node of all lines that are not blank, without blanks at their ends."""
    text = F.when(F.contains("text", F.lit("\r")) | F.contains("text", F.lit("\t")), F.translate("text", "\r\t", "  ")).otherwise(F.col("text"))
    return (
        keyed(documents).select("doc_id", "text_key", F.posexplode(F.split(text, "\n")).alias("place", "raw"))
        .select("doc_id", "text_key", "place", F.trim("raw").alias("line"))
        .filter(F.length("line") > 0).withColumn("node", F.xxhash64("line"))
    )


def shapes(edits: int) -> list[tuple[int, int, int]]:
    """(number, less, shift): for every segment and indexed length the shifts at which a match can lie."""
    return [(number, less, shift) for less in range(edits + 1) for number in range(edits + 1)
            for shift in range(max(-number, less - (edits - number)), min(number, less + (edits - number)) + 1)]


def posted_keys(lines: DataFrame, edits: int) -> DataFrame:
    """node, key, own of the ``lines`` (node, line) under every shape.

    The last segments are one longer where the length does not come out even.  The shapes are rows
    of a constant array, so that one short expression makes all keys.  Of lines with one byte per
    character the bytes are cut, which hash alike and need no search for the place of a character.
    """
    parts = edits + 1
    every = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(k).alias("less"), F.lit(d).alias("shift")) for n, k, d in shapes(edits)])
    # the bytes are taken once for each line, as a cast copies them
    each = lines.select("node", "line", F.col("line").cast("binary").alias("plain"), F.length("line").alias("length"),
                        F.octet_length("line").alias("bytes")).select("*", F.explode(every).alias("shape"))
    number, less, shift = (F.col(f"shape.{name}") for name in ("number", "less", "shift"))
    indexed = F.col("length") - less
    size, evens = F.floor(indexed / parts).cast("int"), F.lit(parts) - (indexed % parts).cast("int")
    start = size * number + F.greatest(number - evens, F.lit(0))
    at, width = start + shift + 1, size + (number >= evens).cast("int")
    key = F.when(F.col("bytes") == F.col("length"), F.xxhash64(number, indexed, F.substring("plain", at, width))).otherwise(
        F.xxhash64(number, indexed, F.substring(F.col("line"), at, width)))
    return each.select("node", key.alias("key"), ((less == 0) & (shift == 0)).alias("own"))


def mark(line: str) -> Column:
    """Two words of parities: of the characters of a line and of its pairs of neighbours, by hash."""
    def parity(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda bits, part: bits.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(part).bitwiseAND(F.lit(63)).cast("int"))))

    letters = F.split(line, "")
    pairs = F.zip_with(letters, F.slice(letters, 2, F.length(line)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array(parity(letters), parity(pairs))


def marks_near(a: Column, b: Column, edits: int) -> Column:
    """Whether marks differ in no more bits than ``edits`` edits can change."""
    def apart(word: int) -> Column:
        return F.bit_count(F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word))))

    return (apart(0) <= 2 * edits) & (apart(1) <= 4 * edits)


def triple_marks(lines: DataFrame) -> DataFrame:
    """node and sharp: the length of a line and four words of parities of its triples of neighbouring characters."""
    letters = F.split("line", "")
    pairs = F.zip_with(letters, F.slice(letters, 2, F.length("line")), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    hashes = F.zip_with(pairs, F.slice(letters, 3, F.length("line")), lambda a, b: F.xxhash64(a, F.coalesce(b, F.lit(""))))
    hashed = lines.select("node", F.length("line").cast("long").alias("length"), hashes.alias("hashes"))

    def parity(word: int) -> Column:
        return F.aggregate("hashes", F.lit(0).cast("long"), lambda bits, h: F.when(
            F.shiftright(h, 6).bitwiseAND(F.lit(3)) == word,
            bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))).otherwise(bits))

    return hashed.select("node", F.array("length", *map(parity, range(4))).alias("sharp"))


def sharp_near(a: Column, b: Column, edits: int) -> Column:
    """Whether length and triples differ by no more than ``edits`` edits can change: six triples each."""
    def word(mark: Column, k: int) -> Column:
        return F.get(mark, F.lit(k))

    apart = sum((F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(2, 5)), F.bit_count(word(a, 1).bitwiseXOR(word(b, 1))))
    return (F.abs(word(a, 0) - word(b, 0)) <= edits) & (apart <= 6 * edits)


def within(a: str, b: str, edits: int) -> Column:
    """Whether two texts are within ``edits`` edits: bit vectors of a band of 2 * edits + 1 rows.

    Bit k of a vector stands for row ``column - edits + k``; ``vp`` and ``vn`` say where the
    distance rises or falls by one from a row to the next.  The score runs along the lowest
    diagonal of the band until the last row, then along that row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def long(value: int) -> Column:
        return F.lit(value).cast("long")

    def inverse(vector: Column) -> Column:
        return vector.bitwiseXOR(long(full))

    def bit_at(vector: Column, place: Column) -> Column:
        return F.getbit(vector, F.greatest(place, F.lit(0))).cast("int")

    def distance(text: Column) -> Column:
        def equal_rows(at: Column) -> Column:
            letter = F.get(text["b"], at)
            bits = long(0)
            for k in range(width):
                bits += F.when(F.get(text["a"], at + (k - edits)) == letter, long(1 << k)).otherwise(long(0))
            return bits

        def column_step(state: Column, cell: Column) -> Column:
            eq, at, vp, vn = cell["eq"], cell["at"], state["vp"], state["vn"]
            same = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(long(full))

            def following(zero: Column) -> Column:
                rise, fall = vn.bitwiseOR(inverse(zero.bitwiseOR(vp))), zero.bitwiseAND(vp)
                down = F.shiftrightunsigned(zero, 1)
                last = text["m"] - at + F.lit(edits - 1)  # the bit of the last row, once the band has reached it
                change = F.when(at < text["m"] - edits, 1 - bit_at(zero, F.lit(2 * edits))).when(
                    last >= 0, bit_at(rise, last) - bit_at(fall, last)).otherwise(0)
                return F.struct(fall.bitwiseOR(inverse(down.bitwiseOR(rise))).alias("vp"), down.bitwiseAND(rise).alias("vn"),
                                (state["score"] + change).alias("score"))

            return F.get(F.transform(F.array(same), following), F.lit(0))

        cells = F.transform(F.sequence(F.lit(0), text["n"] - 1), lambda at: F.struct(at.alias("at"), equal_rows(at).alias("eq")))
        start = F.struct(long(full & ~((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("score"))
        return F.aggregate(cells, start, column_step, lambda state: state["score"])

    # bound once for each pair: inside a lambda an expression would be worked out again at every step
    texts = F.array(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"), F.length(a).alias("m"), F.length(b).alias("n")))
    score = F.get(F.transform(texts, distance), F.lit(0))
    m, n = F.length(a), F.length(b)
    return F.when(F.abs(m - n) > edits, False).when(F.least(m, n) <= edits, F.levenshtein(a, b) <= edits).otherwise(
        score <= edits)


def near_lines(documents: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """node and component of distinct lines that have another one within ``edits`` edits.

    Repeats are left to the grouping of keys and posts, which combines them before the shuffle: to
    make lines distinct first would move all their texts.  Lines are cut from the texts again where they
    are read, as a written copy of them all would stay on disk.
    """
    lines = text_lines(documents).filter(F.length("line") >= least).select("node", "line")
    posts = posted_keys(lines, edits)
    met = posts.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("own").alias("own"))
    keys = small(written(met.filter("own AND low < high").select("key"), "line_keys"))
    posts = written(posts.select("node", "key").join(keys, "key", "left_semi").distinct(), "line_posts")
    nodes = small(written(posts.select("node").distinct(), "line_nodes"))
    texts = written(lines.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select("node", "line", mark("line").alias("mark")),
                    "line_texts")
    posts = written(posts.join(texts.select("node", "mark"), "node").select("node", "key", "mark", F.lit(0).alias("place")), "marked_posts")

    def look(pairs: DataFrame) -> DataFrame:
        of = {n: texts.select(F.col("node").alias(n), F.col("line").alias(f"line_{n}"), F.col("mark").alias(f"mark_{n}")) for n in ("a", "b")}
        both = pairs.join(of["b"], "b").join(of["a"], "a").filter(F.abs(F.length("line_a") - F.length("line_b")) <= edits)
        near = both.filter(marks_near(F.col("mark_a"), F.col("mark_b"), edits))
        return near.filter(within("line_a", "line_b", edits)).select("a", "b")

    def sharpen(still: DataFrame) -> DataFrame:
        """Marks with those of the triples behind them."""
        sharp = triple_marks(texts.join(still.select("node").distinct(), "node", "left_semi"))
        return still.join(sharp, "node").select("node", "key", "component", F.struct("mark", "sharp").alias("mark"), "place")

    def alike(a: Column, b: Column, place: Column) -> Column:
        return marks_near(a["mark"], b["mark"], edits) & sharp_near(a["sharp"], b["sharp"], edits)

    return linked(posts, look, alike=alike, sharpen=sharpen)


def dropped_lines(documents: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, text_key and the sorted places of dropped lines, for documents that lose any."""
    classes = written(near_lines(documents, edits, least), "line_classes")
    lines = text_lines(documents).select("doc_id", "text_key", "place", "node", F.xxhash64(F.lit(1), "line").alias("proof"))
    joined = lines.join(small(classes), "node", "left").select(
        "doc_id", "text_key", "place", F.coalesce("component", "node").alias("class"),
        F.when(F.col("component").isNull(), F.col("proof")).otherwise(F.lit(0)).alias("proof"))
    joined = written(joined, "line_rows")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")
    firsts = written(joined.groupBy("class", "proof").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "line_firsts")
    if is_small(firsts, F.lit(64)):
        both = joined.join(F.broadcast(firsts), ["class", "proof"])
    else:  # a class may hold a large part of all lines: the few large ones are broadcast, so that no task gets all their rows
        large = firsts.filter(F.col("n") >= OFTEN).select("class", "proof", F.col("first").alias("large_first"))
        marked = joined.join(small(large, F.lit(64)), ["class", "proof"], "left")
        rest = marked.filter("large_first IS NULL").drop("large_first").join(firsts.filter(F.col("n") < OFTEN), ["class", "proof"])
        both = rest.drop("n").union(marked.filter("large_first IS NOT NULL").withColumnRenamed("large_first", "first"))
    drops = both.filter(at != F.col("first")).select("doc_id", "text_key", "place")
    return drops.distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("place")).alias("places"))


def without_repeats(documents: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """All rows and columns of ``documents``, with repeated lines cut from ``text``; ``n_chars`` follows if there is one.

    Rows that are equal in doc_id and text are one document and stay alike.  Null texts
    stay null, empty ones empty; a null doc_id comes after all others.  Documents keep
    their row even if no line is left.
    """
    drops = small(written(dropped_lines(documents, edits, least), "line_drops"), 32 + 4 * F.size("places"))
    own = drops.select(F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.col("places").alias("_cut"))
    key = documents["doc_id"].cast("long").eqNullSafe(own["_cut_id"]) & (F.xxhash64(documents["text"]) == own["_cut_key"])
    joined = documents.join(own, key, "left")
    text = F.when(F.col("_cut").isNull(), documents["text"]).otherwise(F.array_join(kept_lines("text", "_cut"), "\n"))
    cut = joined.select(*[text.alias(c) if c == "text" else documents[c] for c in documents.columns], "_cut")
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cut.drop("_cut")


def kept_lines(text: str, places: str) -> Column:
    """Lines of a text without those at the sorted places: the runs between them, put together."""
    starts = F.concat(F.array(F.lit(0)), F.transform(F.col(places), lambda p: p + 1))

    def runs(lines: Column) -> Column:
        return F.zip_with(starts, F.concat(F.col(places), F.array(F.size(lines))), lambda s, e: F.slice(lines, s + 1, e - s))

    # bound once for each text: inside the inner lambda the text would be split again for every run
    return F.flatten(F.get(F.transform(F.array(F.split(text, "\n")), runs), F.lit(0)))


def line_report(documents: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """A row per row of ``documents``: doc_id, n_lines, n_dropped, kept_sha256 of the text that is left."""
    drops = small(written(dropped_lines(documents, edits, least), "line_drops"), 32 + 4 * F.size("places"))
    left = keyed(documents)
    joined = left.join(drops.withColumnRenamed("doc_id", "cut_id").withColumnRenamed("text_key", "cut_key"),
                       left["doc_id"].eqNullSafe(F.col("cut_id")) & (left["text_key"] == F.col("cut_key")), "left")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(kept_lines("text", "places"), "\n"))
    return joined.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
