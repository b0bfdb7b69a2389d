"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Lines that hold more than white space are compared over all documents; of each group of like lines the first stays, by doc_id
and place, and the others go. Equal lines are one to begin with. Two lines link if the Jaccard similarity
of their sets of ``SIZE``-character shingles is ``SIMILARITY`` or more; groups are the connected components.

1. A line's signature is ``ROWS * COLUMNS`` minima of its shingles' hashes, each combined by exclusive or with another
   constant, so a minimum is the shingle nearest to the constant. Shingles are rows that are summed where they arise.
2. Lines that agree in a band share a bucket. The minima stand in a grid; its rows are bands, and so are its diagonals, so each minimum
   is in two bands, and two bands share one minimum at most. At similarity 0.8 two lines meet in one of 12 bands of 4 with
   probability 0.990, at 0.85 with 0.998, were the minima independent; what lines of different lengths really have is measured in
   the tests and given in the README.
3. The most frequent line of a bucket leads it, and the buckets with one lead are a class. Each line of a class is compared
   exactly with the lead. Lines that are then in another component than the lead are compared with all lines outside their own
   component that share a bucket of the class with them (a bit for each band tells it), so no link within a bucket is lost.
4. Lines whose buckets each hold lines of one component only have nothing to be compared with and end here. Before the others' exact
   comparison two lines' bitmaps are compared: each shingle sets one of ``64 * WORDS`` bits, and a bit that one line
   has and the other hasn't stands for at least one shingle that they don't share. Where there are more such bits than the
   similarity allows, the exact one is lower, so this rules out nothing that links. Most pairs that don't link end here, at the
   price of some bit counts within the join. Lines left over bring their sets to that join, and the others end there.
5. Where classes could give more pairs than ``SPARSE`` times the lines left over, as very large groups of near copies do, these lines are first
   compared with ``SOME`` lines of their class only, others each time, while that halves them; what is left is compared in whole.
6. Components are found by star contraction, and the lines that stay are joined back to their texts.

Edge cases: a null text stays null; an empty text and blank lines stay as they are; lines shorter than a shingle are compared as
wholes; a text whose lines all go becomes what blank lines it has; a null doc_id comes after all others; of rows equal in doc_id and
text one counts as the first, and the others lose their lines; an empty table gives an empty result; other columns stay, whatever
their names (except names that begin with two underscores).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, reclaim, require, table, written
from .components import components

SIZE = 8
SIMILARITY = 0.8
ROWS = 6
COLUMNS = 4
#: The minima of each band.
BANDS = tuple(tuple(COLUMNS * r + c for c in range(COLUMNS)) for r in range(ROWS)) + tuple(tuple(COLUMNS * ((c + s) % ROWS) + c for c in range(COLUMNS)) for s in range(ROWS))
#: Shingles that a row holds while minima are taken: with more, fewer rows are summed, but the least within a row takes more time.
STEP = 4
#: 64-bit words of a line's bitmap.
WORDS = 32
#: Pairs in classes, as a multiple of the lines left over, up to which they are compared at once.
SPARSE = 64
#: Lines of a class that those left over are compared with before all others.
SOME = 8
#: Lines that a part of a class has on average at most.
PART = 2048
#: Pairs and lines up to which what lines left over are compared with isn't dealt out to more tasks.
TASK_PAIRS = 1 << 16
TASK_LINES = 1 << 13
#: Most rows of ids or pairs of ids that are broadcast; more are joined by shuffling.
BROADCAST = 300_000
#: 64-bit words in a row of the table that tells most keys of one line from shared ones, places for each shared key there, and most rows.
CELLS = 8
PLACES = 8
ROWS_MOST = 1 << 18

ORDER = ("absent", "doc_id", "at", "pos")
#: The white space of a regular expression's ``\\s``.
BLANKS = " \t\n\x0b\f\r"


def anchors(count: int) -> list[int]:
    """Constants spread over the signed 64-bit integers: their leading bits differ, the others follow the golden ratio."""
    golden = 0x9E3779B97F4A7C15
    wide = [(i * (1 << 64) // count) | (golden * (i + 1) & (1 << 64) // count - 1) for i in range(count)]
    return [x - (1 << 64) if x >> 63 else x for x in wide]


def address() -> Column:
    return F.xxhash64("doc_id", "text")


def solid(line: Column) -> Column:
    """Whether a line isn't blank; looks at a line's first characters only."""
    return F.ltrim(line, F.lit(BLANKS)) != ""


def wide(line: Column) -> Column:
    """Four bytes to a character, so that a shingle is found by its place."""
    return F.encode(line, "UTF-32")


def occurrences(docs: DataFrame) -> DataFrame:
    """(absent, doc_id, at, pos, line) of every line that isn't blank."""
    # The address is found in a step of its own; what stands beside explode is computed for every line.
    whole = docs.filter("text is not null").select(F.col("doc_id").isNull().alias("absent"), "doc_id", address().alias("at"), "text")
    rows = whole.select("absent", "doc_id", "at", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.filter(solid(F.col("line")))


def signatures(lines: DataFrame) -> DataFrame:
    """One row for each line that differs: its hash, its frequency ``n``, its first place and the hashes of its bands."""
    first = F.min(F.struct(*ORDER)).alias("first")
    each = lines.withColumn("line_id", F.xxhash64("line")).groupBy("line_id").agg(F.count("*").alias("n"), first, F.first("line").alias("line"))
    # The line is widened in a step of its own; what stands beside explode is computed for every shingle. So are the places within a row,
    # which are the same in all rows of a line: the last row is moved back to end with the line, and lines shorter than a row repeat their last shingle.
    last = F.greatest(F.length("line") - SIZE, F.lit(0)).alias("last")
    pairs = each.select("line_id", "n", "first.*", "line", last, F.length("line").alias("chars"), F.encode("line", "UTF-16BE").alias("units"))
    # Two bytes to a character, four where a line has characters that take two units of UTF-16; a shingle is hashed as UTF-16 in either case.
    plain = pairs.withColumn("plain", F.octet_length("units") == 2 * F.col("chars")).withColumn("bytes", F.when(F.col("plain"), 2).otherwise(4))
    widened = plain.select("line_id", "n", *ORDER, "plain", "bytes", F.when(F.col("plain"), F.col("units")).otherwise(wide(F.col("line"))).alias("wide"), "last")
    widened = widened.select("*", (SIZE * F.col("bytes")).alias("size"), *[F.expr(f"bytes * least({j}, last) + 1").alias(f"p{j}") for j in range(STEP)])
    exploded = widened.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP)))).withColumn("from", F.expr(f"bytes * greatest(least(i, last - {STEP - 1}), 0)"))

    def hashed(j: int) -> Column:
        shingle = f"substring(wide, from + p{j}, size)"
        # A blank goes before it, as a mark of the byte order would be dropped there.
        return F.xxhash64(F.expr(f"if(plain, {shingle}, substring(encode(decode(concat(X'00000020', {shingle}), 'UTF-32'), 'UTF-16BE'), 3))"))

    minima = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(c)) for j in range(STEP)])).alias(f"m{i}") for i, c in enumerate(anchors(ROWS * COLUMNS))]
    # The frequency and first place are alike for all shingles of a line, whose rows are in one partition already. Keys cost more than minima;
    # doc_id is one as it may be of a type that has no place in a buffer of sums.
    alike = [F.min(c).alias(c) for c in ("n", *ORDER) if c != "doc_id"]
    found = exploded.select("line_id", "n", *ORDER, *[hashed(j).alias(f"h{j}") for j in range(STEP)]).groupBy("line_id", "doc_id").agg(*alike, *minima)

    def packed(b: int) -> Column:
        """A hash of a band's minima."""
        return F.xxhash64(F.lit(b), *[f"m{i}" for i in BANDS[b]])

    return found.select("line_id", "n", *ORDER, *[packed(b).alias(f"b{b}") for b in range(len(BANDS))])


def perhaps(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """Those of ``keys(key, ...)`` that can be in ``shared(key)``, a written table: all that are, and about one in ``PLACES`` of the others.

    Each shared key sets one bit of a broadcast table, so the other keys, which are most, aren't shuffled to be looked up. Where shared keys
    are so many that the table has fewer places than it should, more of the others are left.
    """
    rows, count = 1, shared.count()
    while rows < ROWS_MOST and rows * 64 * CELLS < PLACES * count:
        rows *= 2
    place = F.expr(f"key div {rows}")
    row, cell, bit = F.col("key") % rows, place.bitwiseAND(64 * CELLS - 64), F.expr(f"shiftleft(1L, cast((key div {rows}) & 63 as int))")
    cells = [F.bit_or(F.when(cell == 64 * c, bit).otherwise(0)).alias(f"__c{c}") for c in range(CELLS)]
    places = F.broadcast(shared.groupBy(row.alias("__row")).agg(*cells))
    word = reduce(lambda rest, c: F.when(cell == 64 * c, F.col(f"__c{c}")).otherwise(rest), range(CELLS), F.lit(0).cast("long"))
    return keys.join(places, row == F.col("__row")).filter(word.bitwiseAND(bit) != 0).select(*keys.columns)


def classes(found: DataFrame) -> DataFrame:
    """(line_id, lead, bands): each line with the most frequent line of each of its buckets, other than itself, and a bit for each band of these buckets."""
    # As many bits of the bands' hashes as keep chance agreements to about one in 4,096 rows.
    bits = min(64, 12 + max(1, math.ceil(math.log2(1 + found.count() * len(BANDS)))))
    keys = found.select(F.posexplode(F.array(*[F.shiftrightunsigned(f"b{b}", 64 - bits) for b in range(len(BANDS))])).alias("b", "key"), "line_id", "n")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key"), "shared")
    reclaim(found.sparkSession)
    rows = written(perhaps(keys, shared).join(shared.hint("shuffle_hash"), "key"), "buckets")
    discard(shared)
    lead = rows.groupBy("key").agg(F.max(F.struct("n", "line_id")).alias("lead")).select("key", F.col("lead.line_id").alias("lead"))
    out = written(rows.join(lead, "key").filter("line_id <> lead").groupBy("line_id", "lead").agg(F.bit_or(F.expr("shiftleft(1, b)")).alias("bands")), "classes")
    discard(rows)
    return out


def small(rows: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(line_id, line) of the lines whose ids are in ``ids(line_id)``, a written table."""
    lines = occurrences(docs).select(F.xxhash64("line").alias("line_id"), "line")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST else ids.hint("shuffle_hash")
    return lines.join(chosen, "line_id", "left_semi").groupBy("line_id").agg(F.first("line").alias("line"))


def shingles(line: str) -> Column:
    places = F.expr(f"sequence(1, 4 * greatest(length({line}) - {SIZE}, 0) + 1, 4)")
    return F.transform(F.array(wide(F.col(line))), lambda w: F.transform(places, lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * SIZE)))))[0]


def bitmaps(texts: DataFrame, step: int = 8) -> DataFrame:
    """(line_id, size, z0, z1, ...) of ``texts(line_id, line)``: how many shingles a line has at most, and its bitmap."""
    last = F.greatest(F.length("line") - SIZE, F.lit(0))
    widened = texts.select("line_id", wide(F.col("line")).alias("wide"), last.alias("last"))
    each = widened.select("line_id", "wide", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(step))).alias("i"))
    hashed = each.select("line_id", "last", *[F.xxhash64(F.expr(f"substring(wide, 4 * least(i + {j}, last) + 1, {4 * SIZE})")).alias(f"h{j}") for j in range(step)])
    word, bit = (lambda j: f"cast(h{j} & {WORDS - 1} as int)"), (lambda j: f"shiftleft(1L, cast(shiftrightunsigned(h{j}, 32) & 63 as int))")
    placed = hashed.select("line_id", "last", *[F.expr(f(j)).alias(f"{n}{j}") for j in range(step) for n, f in (("w", word), ("b", bit))])
    words = [F.bit_or(F.expr(" | ".join(f"if(w{j} = {w}, b{j}, 0L)" for j in range(step)))).alias(f"z{w}") for w in range(WORDS)]
    return placed.groupBy("line_id", (F.col("last") + 1).alias("size")).agg(*words)


def side(name: str) -> list[Column]:
    """Size and bitmap, never null, as those of a pair's ``name``."""
    return [F.coalesce("size", F.lit(0)).alias(f"{name}_size"), *[F.coalesce(f"z{w}", F.lit(0).cast("long")).alias(f"{name}_z{w}") for w in range(WORDS)]]


def near(similarity: float) -> Column:
    """False only where the bitmaps of u and v differ in more bits than those of lines as similar as that can."""
    total = F.lit(0)
    for w in range(WORDS):
        total = total + F.bit_count(F.col(f"u_z{w}").bitwiseXOR(F.col(f"v_z{w}")))
    return (1 + similarity) * total <= (1 - similarity) * (F.col("u_size") + F.col("v_size")) + 1e-6


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the written ``pairs(u, v)`` whose lines in ``texts(line_id, line)`` are as similar as that."""
    left = texts.select(F.col("line_id").alias("u"), F.col("line").alias("x"))
    right = texts.select(F.col("line_id").alias("v"), F.col("line").alias("y"))
    met = left.join(small(pairs), "u").join(right, "v")
    # What explode gives isn't replaced by its expression in the filter, so the shingles of each line are hashed once.
    hashed = met.select("u", "v", F.explode(F.array(F.struct(shingles("x").alias("a"), shingles("y").alias("b")))).alias("p")).select("u", "v", "p.*")
    # |a & b| >= s |a | b| is (1 + s) |a & b| >= s (|a| + |b|).
    total = similarity * (F.size(F.array_distinct("a")) + F.size(F.array_distinct("b"))) - 1e-6
    return hashed.filter((1 + similarity) * F.size(F.array_intersect("a", "b")) >= total).select("u", "v")


def meeting(placed: DataFrame) -> DataFrame:
    """``placed(lead, line_id, bands, own, ...)`` without buckets, and so without lines, that have lines of one component only.

    Nothing in such a bucket is still to be compared. Most buckets are such: they have the lead and one line or its near copies.
    """
    has = [F.when(F.col("bands").bitwiseAND(F.lit(1 << b)) != 0, F.col("own")) for b in range(len(BANDS))]
    mixed = reduce(Column.bitwiseOR, [F.when(F.min(x) != F.max(x), 1 << b).otherwise(0) for b, x in enumerate(has)])
    open_ = placed.groupBy("lead").agg(mixed.alias("open")).filter("open <> 0")
    return placed.join(open_, "lead").withColumn("bands", F.col("bands").bitwiseAND(F.col("open"))).filter("bands <> 0").drop("open")


def left_over(stars: DataFrame, groups: DataFrame) -> tuple[DataFrame, int, int]:
    """``stars`` that are still to be compared, with their components and whether that isn't their lead's; how many such lines there are and how many pairs at most."""
    own = groups.select(F.col("node").alias("line_id"), F.col("component").alias("own"))
    main = groups.select(F.col("node").alias("lead"), F.col("component").alias("main"))
    few = groups.count() <= BROADCAST
    own, main = (F.broadcast(own), F.broadcast(main)) if few else (own, main)
    placed = stars.join(own, "line_id", "left").join(main, "lead", "left").withColumn("own", F.coalesce("own", "line_id"))
    placed = written(meeting(placed.withColumn("left", F.col("own") != F.coalesce("main", "lead")).drop("main")), "placed")
    sizes = placed.groupBy("lead").agg(F.count("*").alias("n"), F.sum(F.col("left").cast("long")).alias("lefts"))
    lefts, pairs = sizes.agg(F.coalesce(F.sum("lefts"), F.lit(0)), F.coalesce(F.sum(F.col("lefts").cast("double") * F.col("n")), F.lit(0.0))).first()
    return placed, int(lefts), int(pairs)


def nearby(placed: DataFrame, lines: DataFrame, similarity: float, turn: int | None = None) -> DataFrame:
    """(u, v): lines left over that link with lines of their class in other components.

    The sets are sent to where the lines meet, so a pair that doesn't link is never a row. A class is dealt out as a grid of parts of
    the lines left over and of the lines that they are compared with. With a ``turn`` only ``SOME`` lines of each class are compared
    with, others in each turn.
    """
    left, others = placed.filter("left"), placed
    if turn is not None:
        place = F.row_number().over(W.partitionBy("lead").orderBy(F.xxhash64("line_id", F.lit(turn)), "line_id"))
        others = placed.withColumn("place", place).filter(F.col("place") <= SOME).drop("place")
    count = others.groupBy("lead").agg(F.count("*").alias("n"))
    sizes = left.groupBy("lead").agg(F.count("*").alias("lefts")).join(count, "lead")
    sizes = written(sizes.select("*", *[F.ceil(F.col(c) / PART).cast("int").alias(p) for c, p in (("lefts", "rows"), ("n", "columns"))]), "sizes")
    grid = small(sizes.select("lead", "rows", "columns"))
    # Only lines that share a bucket are compared. A pair of two lines left over is taken once, where both would find it.
    once = (F.col("u_own") != F.col("v_own")) & (F.col("u_bands").bitwiseAND(F.col("v_bands")) != 0)
    if turn is None:
        once &= ~F.col("v_left") | (F.col("u") < F.col("v"))
    met = (F.col("lead") == F.col("lead_")) & (F.col("row") == F.col("row_")) & (F.col("column") == F.col("column_")) & once & near(similarity)
    # Cells cost pairs, not bytes, so they aren't gathered into fewer tasks by size, but by pairs and lines: a task's buffers cost more than few of these.
    pairs, copies = sizes.agg(*[F.coalesce(F.sum(F.expr(x)), F.lit(0.0)) for x in ("double(lefts) * n", "double(lefts) * columns + double(n) * rows")]).first()
    tasks = min(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + int(max(pairs / TASK_PAIRS, copies / TASK_LINES)))

    def sides(known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The two sides of the grid, with the bitmaps and sets of ``known``, and without lines that aren't there."""
        u, v = ([F.col("set").alias(x)] if "set" in known.columns else [] for x in "ab")
        one, two = (x.join(grid, "lead").join(known, "line_id").withColumn("at", F.pmod(F.hash("line_id"), F.col(n))) for x, n in ((left, "rows"), (others, "columns")))
        one = one.select("lead", F.col("at").alias("row"), F.explode(F.expr("sequence(0, columns - 1)")).alias("column"), F.col("line_id").alias("u"), F.col("own").alias("u_own"), F.col("bands").alias("u_bands"), *u, *side("u"))
        two = two.select(
            F.col("lead").alias("lead_"), F.explode(F.expr("sequence(0, rows - 1)")).alias("row_"), F.col("at").alias("column_"), F.col("line_id").alias("v"), F.col("own").alias("v_own"),
            F.col("left").alias("v_left"), F.col("bands").alias("v_bands"), *v, *side("v"),
        )
        return one.repartition(tasks, "lead", "row", "column"), two.repartition(tasks, "lead_", "row_", "column_")

    # Sets are made of lines only that the bitmaps let meet another line.
    one, two = sides(lines.drop("line"))
    able = one.join(two, met, "left_semi").select(F.col("u").alias("line_id")).unionByName(two.join(one, met, "left_semi").select(F.col("v").alias("line_id")))
    able = written(able.distinct(), "able")
    sets = written(lines.join(small(able), "line_id", "left_semi").withColumn("line", F.array_distinct(shingles("line"))).withColumnRenamed("line", "set"), "sets")
    # As in verified, the sets are intersected once; the cheap tests come first.
    total = similarity * (F.size("a") + F.size("b")) - 1e-6
    alike = ((1 + similarity) * F.least(F.size("a"), F.size("b")) >= total) & ((1 + similarity) * F.size(F.array_intersect("a", "b")) >= total)
    one, two = sides(sets)
    return one.join(two, met & alike).select("u", "v").distinct()


def like_lines(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the lines that link with others; ``found`` is a written table of signatures."""
    stars = classes(found)
    needed = written(stars.select(F.explode(F.array("line_id", "lead")).alias("line_id")).distinct(), "needed")
    texts = written(texts_of(docs, needed), "texts")
    discard(needed)
    links = []

    def join(pairs: DataFrame) -> bool:
        """Adds ``pairs`` to the links; whether there are any."""
        links.append(written(pairs, "links"))
        return not links[-1].isEmpty()

    def joined() -> DataFrame:
        return written(components(reduce(DataFrame.unionByName, links)), "groups")

    join(verified(stars.select(F.col("line_id").alias("u"), F.col("lead").alias("v")), texts, similarity))
    groups, turn = joined(), 0
    placed, lefts, pairs = left_over(stars, groups)
    # Components only grow, so no other line is compared later.
    rest = written(placed.select("line_id").distinct(), "rest")
    few = written(texts.join(small(rest), "line_id"), "few")
    lines = written(few.join(bitmaps(few), "line_id"), "lines")
    discard(texts, rest, few)
    before = 2 * lefts
    while pairs > SPARSE * max(1, lefts) and 2 * lefts <= before and join(nearby(placed, lines, similarity, turn)):
        discard(groups, placed)
        groups, turn, before = joined(), turn + 1, lefts
        placed, lefts, pairs = left_over(stars, groups)
    if lefts and join(nearby(placed, lines, similarity)):
        discard(groups)
        groups = joined()
    discard(stars, lines, placed, *links)
    return groups


def dedupe_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``) as it is without the lines that go, and ``__lines``, ``__kept``, counts of lines not blank before and after."""
    require(docs, "doc_id", "text")
    spark = docs.sparkSession
    found = written(signatures(occurrences(docs)), "signatures")
    reclaim(spark)
    groups = like_lines(docs, found, similarity)
    named = found.select("line_id", F.struct(*ORDER).alias("first")).join(groups.withColumnRenamed("node", "line_id"), "line_id", "left")
    alone = named.filter("component is null").select("first.at", "first.pos")
    firsts = named.filter("component is not null").groupBy("component").agg(F.min("first").alias("first")).select("first.at", "first.pos")
    stay = written(alone.unionByName(firsts).groupBy(F.col("at").alias("__at")).agg(F.collect_list("pos").alias("__stay")), "stay")
    discard(found, groups)
    none = F.array().cast("array<int>")
    # Both sides are sorted by address for the join, and repeated rows are next to each other then.
    joined = docs.withColumn("__at", address()).join(stay.hint("merge"), "__at", "left").withColumn("__stay", F.coalesce("__stay", none))
    turn = F.row_number().over(W.partitionBy("__at").orderBy("__at"))
    once = joined.withColumn("__turn", turn).withColumn("__stay", F.when(F.col("__turn") == 1, F.col("__stay")).otherwise(none))

    def rebuilt(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(~solid(x), i)), lambda i: i.isNotNull())
        places = F.sort_array(F.concat(F.col("__stay"), blank))
        return F.struct(F.array_join(F.transform(places, lambda p: F.get(lines, p)), "\n").alias("text"), (F.size(lines) - F.size(blank)).alias("lines"))

    # The lines are bound to a lambda's variable so that the text is split once.
    out = once.withColumn("__new", F.transform(F.array(F.split("text", "\n", -1)), rebuilt)[0])
    columns = {"text": F.when(F.col("text").isNotNull(), F.col("__new.text")), "__lines": F.coalesce("__new.lines", F.lit(0)).cast("long"), "__kept": F.size("__stay").cast("long")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(F.col("__new.text")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(columns).select(*docs.columns, "__lines", "__kept")


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` after line deduplication, without the documents of which no line stays though they had some; columns as before."""
    return dedupe_lines(docs, similarity).filter("__kept > 0 or __lines = 0").select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the text that stays; of rows equal in doc_id and text one keeps its lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_lines(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__kept").alias("n_kept"), "text")
