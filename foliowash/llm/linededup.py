"""Line de-duplication: an exact set-similarity join on lines, with DataFrame functions only.

A line is what stands between line feeds; its tokens are the distinct words of the lower-cased line. A line
is removed if an earlier line (by doc_id, then line number) has a Jaccard similarity of ``THRESHOLD`` or
more to it, whether or not that earlier line stays itself.

1. Tokens are ordered by rarity: their counts over all lines, by 2^16 hash cells, form a table of fixed
   size; the order is by the cells' counts, then by hash, the same for all lines.
2. Lines of equal token sets (128 bits of hash and the size) are one class; all but the first are removed.
3. Classes meet on the pairs of neighbours in the rarest part of this order. If a and b tokens of two sets
   of n1 and n2 tokens have no partner, each of them parts at most one of the neighbours that the sets
   share, so some shared pair of neighbours starts at place 2a + b of the first set or before, which is at
   most 2/5 of its size at the threshold: a prefix of that length, with two tokens a key instead of one, so
   that frequent tokens do not bring unlike lines together. Length and positional filters drop pairs of
   classes that can't reach the threshold; the others are verified on their whole sets of words.
4. Each class is first compared with the two before it, the first one and the one of most copies under
   each of its keys, which settles groups of near copies in linear time. Only classes that match none of those are joined with all
   earlier ones of a key, where a 64-bit parity sketch of the whole set drops most unlike pairs, and a pair is made under the first
   key that it shares only. So no group's pairs are all made, and none is lost.

Edge cases: blank lines stay and match nothing; null texts stay null; rows with a null doc_id stay whole
and take no part; equal rows have the same places, and equal places never remove each other; different
texts of one doc_id are ordered by their hash, each with lines of its own; an empty table stays empty;
other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliowash.llm.common import drop_stage, held, quoted, write_stage

THRESHOLD = (4, 5)  # 0.8, in whole numbers
_CELL_BITS = 16
_PLACE = ["doc_id", "row", "line_no"]
_BLANK = " \t\v\f\r"
_FAST_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: For writes of hashes, which no dictionary shortens, and of aggregates with a group for almost every row.
_HASHES = {"parquet.enable.dictionary": "false"}
_MANY_GROUPS = {"spark.sql.codegen.aggregate.map.twolevel.enabled": "false"}


def _clean(text: Column) -> Column:
    """Other white space than line feeds becomes spaces; most texts have none and are left as they are."""
    odd = F.lit(False)
    for c in "\t\v\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def _place(docs: DataFrame) -> list[str]:
    """The columns that name and order lines: one number if all doc_ids are different and below 2^32, or
    else doc_id, a hash of the text, which tells texts of one doc_id apart, and line_no."""
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().agg(F.min("doc_id"), F.max("doc_id"), F.max("count")).first()
    return ["at"] if ids[2] is None or (ids[0] >= 0 and ids[1] < 1 << 32 and ids[2] == 1) else ["doc_id", "row", "line_no"]


def _row(place: list[str]) -> Column:
    return (F.xxhash64("text") if "row" in place else F.lit(0).cast("long")).alias("row")


def _raw(docs: DataFrame, place: list[str]) -> DataFrame:
    """doc_id, row and text of rows that take part."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _row(place), "text")


def _texts(raw: DataFrame) -> DataFrame:
    # the lower-cased text is a column of its own, or each use would compute it anew
    return raw.withColumn("text", F.lower("text")).withColumn("text", _clean(F.col("text")))


def _lines(texts: DataFrame, place: list[str]) -> DataFrame:
    lines = texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("line <> ''")
    at = F.shiftleft(F.col("doc_id").cast("long"), 31).bitwiseOR(F.col("line_no"))
    return lines.select(at.alias("at"), "line") if place == ["at"] else lines.select(*place, "line")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " ", -1), "")


def _rarity(raw: DataFrame) -> DataFrame:
    """One row with an array by the first ``_CELL_BITS`` bits of a token's hash: what turns them, by exclusive
    or, into the rank of that cell's count over all texts. Its size is fixed, whatever the input's. Words are
    counted as they are written, not in lower case: any order that is the same for all lines gives the same pairs."""
    shift = 64 - _CELL_BITS
    token = F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("token")
    counts = raw.select(token).where("token <> ''").groupBy(F.shiftrightunsigned(F.xxhash64("token"), shift).cast("int").alias("cell")).count()
    order = Window.orderBy("count", "cell")  # one row a cell
    turn = F.shiftleft(F.col("cell").bitwiseXOR(F.row_number().over(order) - 1).bitwiseXOR(F.lit(1 << (_CELL_BITS - 1))).cast("long"), shift)
    turns = counts.select("cell", turn.alias("turn"))
    every = raw.sparkSession.range(1 << _CELL_BITS).select(F.col("id").cast("int").alias("cell")).join(turns, "cell", "left")
    # the small hash table of generated code holds all cells
    with held(raw.sparkSession, {_FAST_BITS: str(_CELL_BITS + 2)}):
        return _array(every.select("cell", F.coalesce("turn", F.lit(0).cast("long")).alias("value")), "cell")


def _array(rows: DataFrame, index: str) -> DataFrame:
    """One written row: the values in order of the index. It enters plans as a scalar subquery."""
    pairs = F.sort_array(F.collect_list(F.struct(index, "value")))
    return write_stage(rows.agg(F.transform(pairs, lambda c: c["value"]).alias("values")), "array")


def _keys(line: Column, rarity: Column) -> Column:
    """Token keys in order of their cells' counts: hashes with other first bits."""
    hashes = F.array_distinct(F.transform(_words(line), lambda x: F.xxhash64(x)))
    # never null, so that plain numbers are sorted
    key = lambda h: h.bitwiseXOR(F.coalesce(F.get(rarity, F.shiftrightunsigned(h, 64 - _CELL_BITS)), F.lit(0).cast("long")))
    return F.sort_array(F.transform(hashes, key))


def _sketch(keys: Column) -> Column:
    """64 bits, of which each token flips one: two sketches differ in no more bits than their sets in tokens."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))))


def _may_match(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Length and positional filter: necessary for overlap / (n1 + n2 - overlap) >= 4 / 5, that is
    9 * overlap >= 4 * (n1 + n2), where the first shared pair of neighbours has the places p1 and p2. The tokens
    shared before it are all parted, by one of the others before it each: they are a third of those at most."""
    t, u = THRESHOLD
    most = F.least(p1, p2, F.floor((p1 + p2) / 3)) + F.least(n1 - p1, n2 - p2)
    return (n1 * u >= n2 * t) & (n2 * u >= n1 * t) & (most * (t + u) >= (n1 + n2) * t)


def _as(prefix: str, columns: list[str]) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def _before(place: list[str]) -> Column:
    """The place with the prefix ``a_`` comes before the other."""
    return F.struct(*[F.col(f"a_{c}") for c in place]) < F.struct(*place) if len(place) > 1 else F.col(f"a_{place[0]}") < F.col(place[0])


def _filter_of(pairs: DataFrame, place: list[str]) -> Column:
    """A Bloom filter of one hash over both places of pairs: a test of the columns of ``place``. Its size
    follows the number of pairs up to 2^24 bits; beyond, more lines than needed pass."""
    places = pairs.select(*place).unionByName(pairs.select(*[F.col(f"a_{c}").alias(c) for c in place]))
    bits = 1 << min(24, max(16, (8 * places.count()).bit_length()))
    k = F.xxhash64(*place).bitwiseAND(F.lit(bits - 1))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    words = places.select(k.alias("k")).groupBy(F.shiftrightunsigned("k", 6).cast("int").alias("word")).agg(F.bit_or(one(F.col("k"))).alias("bits"))
    every = pairs.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    table = _array(every.select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("value")), "word")
    return F.get(table.scalar(), F.shiftrightunsigned(k, 6)).bitwiseAND(one(k)) != 0


def _join_both(pairs: DataFrame, rows: DataFrame, place: list[str], *columns: str) -> DataFrame:
    """``pairs`` with ``columns`` of both places (prefixes ``b_`` and, of the earlier one, ``a_``). Both sides
    are alike but for names, so that Spark reads and deals out ``rows`` once."""
    later, earlier = (rows.select(*_as(x, [*place, *columns])) for x in ("b_", "c_"))
    same = lambda x, y: [F.col(x + c) == F.col(y + c) for c in place]
    # never broadcast: a join of each kind would read the lines twice
    both = pairs.join(later.hint("merge"), same("", "b_")).join(earlier.hint("merge"), same("a_", "c_"))
    return both.select(*pairs.columns, *[f"b_{c}" for c in columns], *[F.col(f"c_{c}").alias(f"a_{c}") for c in columns])


def _matching(pairs: DataFrame, classes: DataFrame, raw: DataFrame, place: list[str]) -> DataFrame:
    """Of pairs of a place and an earlier one (prefix ``a_``), the places of those whose sets of words match.

    First the positional filter once more: what two sets share lies in both prefixes, or beyond the one that
    ends first. Then the words of the lines that are left are read and compared.
    """
    t, u = THRESHOLD
    both = _join_both(pairs, classes.where(_filter_of(pairs, place)), place, "n", "prefix")
    most = F.size(F.array_intersect("b_prefix", "a_prefix")) + F.greatest(F.col("b_n") - F.size("b_prefix"), F.col("a_n") - F.size("a_prefix"))
    close = write_stage(both.where(most * (t + u) >= (F.col("b_n") + F.col("a_n")) * t).select(*pairs.columns, (F.col("b_n") + F.col("a_n")).alias("sizes")), "close_pairs")
    lines = _lines(raw, place).where(_filter_of(close, place)).withColumn("line", F.lower("line")).withColumn("line", _clean(F.col("line")))
    if "row" in place:  # equal rows have equal places
        lines = lines.dropDuplicates(place)
    # the sizes of both sets are known, so their union says what they share
    union = F.size(F.array_union(_words(F.col("b_line")), _words(F.col("a_line"))))
    both = _join_both(close, lines, place, "line").where(F.col("sizes") * u >= union * (t + u))
    out = write_stage(both.select(*place).distinct(), "matched")
    drop_stage(close)
    return out


def _kept(docs: DataFrame, place: list[str]) -> DataFrame:
    """The places of lines that no earlier line removes; of blank ones, the first of all."""
    t, u = THRESHOLD
    raw = _raw(docs, place)
    texts = _texts(raw)
    rarity = _rarity(raw)
    # a subquery can't stand in a lambda function, but the optimizer puts it there
    keyed = _lines(texts, place).withColumn("turns", rarity.scalar()).withColumn("keys", _keys(F.col("line"), F.col("turns"))).drop("turns")
    n = F.size("keys")
    # sets of fewer than 4 tokens can only match equal ones
    prefix = F.when(n >= 4, F.slice("keys", F.lit(1), F.floor(n * (2 * (u - t)) / u).cast("int") + 2))
    keyed = keyed.select(*place, n.alias("n"), F.xxhash64("keys").alias("h1"), F.xxhash64(F.lit(1), "keys").alias("h2"), prefix.alias("prefix"), _sketch(F.col("keys")).alias("bits"))
    first = F.struct(*place)
    classes = keyed.groupBy("h1", "h2", "n", "bits").agg(F.min(first).alias("f"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("lines"))
    with held(docs.sparkSession, _HASHES):
        classes = write_stage(classes.select("f.*", "n", "bits", "prefix", F.floor(F.log2("lines")).alias("copies")), "classes")

    following = F.slice("prefix", F.lit(2), F.size("prefix") - 1)
    posted = classes.where("n >= 4").select(*place, "n", "copies", "prefix", F.posexplode(following).alias("p", "next"))
    posted = posted.withColumn("key", F.xxhash64(F.get("prefix", F.col("p")), "next"))
    # the size, the place in the prefix and the number of copies in one number
    about = F.shiftleft(F.col("n").cast("long"), 34).bitwiseOR(F.shiftleft(F.col("p").cast("long"), 6)).bitwiseOR(F.col("copies")).alias("about")
    # a key's classes are counted first, in a hash table: most keys have one and are done with, and those of two
    # are told by their ends, so that only the others are sorted. Both uses read one shuffle.
    dealt = posted.select(*place, about, "key").repartition("key")
    at = F.struct(*place) if len(place) > 1 else F.col(place[0])
    ends = [f(c).alias(f"{x}_{name}") for name, c in (("at", at), ("about", F.col("about"))) for x, f in (("low", F.min), ("high", F.max))]
    groups = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("times"), *ends).where("times > 1")
    size, where = lambda c: F.shiftright(c, 34), lambda c: F.shiftright(c, 6).bitwiseAND(F.lit((1 << 28) - 1))

    def may_match(a: str, b: str) -> Column:
        return _may_match(size(a), where(a), size(b), where(b))

    two = F.col("times") == 2
    met = dealt.join(groups.hint("shuffle_hash"), "key").where(~two | ((at == F.col("high_at")) & may_match("low_about", "high_about")))
    order = Window.partitionBy("key").orderBy(*place)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # plain numbers where there are any: a struct for each of these took most of the time
    one = lambda name, k: [F.lag(c, k).over(order).alias(f"{name}_{x}") for x, c in (("at", at), ("about", F.col("about")))]
    copies = F.col("about").bitwiseAND(F.lit(63))
    # among those without copies, it would be the last
    most = F.max(F.when(copies > 0, F.struct(copies.alias("copies"), at.alias("at"), F.col("about")))).over(before)
    met = met.select(*place, "about", "key", "times", F.col("low_at").alias("top_at"), F.first("about").over(before).alias("top_about"), *one("last", 1), *one("other", 2), most.alias("most"))
    met = met.select("*", F.col("most.at").alias("most_at"), F.col("most.about").alias("most_about"))
    # without those that the filters drop, which they would drop from the join under this key too
    looked = ("last", "other", "top", "most")
    # with nulls and repeats, as a set for each row took a third of the window's time; distinct() drops them
    looks = F.array(*[F.when(may_match("about", f"{c}_about"), F.col(f"{c}_at")) for c in looked])
    looks = F.when(two, F.array("top_at")).when(F.col("last_at").isNotNull(), looks)
    # rows that look at none, under a key all of whose pairs are looked at, are done with too
    used = two | (F.col("times") > 4)
    for c in looked:
        used = used | F.coalesce(may_match("about", f"{c}_about"), F.lit(False))
    with held(docs.sparkSession, _HASHES | _MANY_GROUPS):
        met = write_stage(met.where(used).select(*place, "about", "key", "times", looks.alias("looks")), "met")
    pair = [*place, *[f"a_{c}" for c in place]]
    named = [F.col("a").alias(f"a_{place[0]}")] if len(place) == 1 else [F.col(f"a.{c}").alias(f"a_{c}") for c in place]
    near = write_stage(met.select(*place, F.explode("looks").alias("a")).where("a IS NOT NULL").select(*place, *named).distinct(), "near_pairs")
    settled = _matching(near, classes, raw, place)

    # all pairs of up to four classes of a key are among those looked at
    # one row of them for each key, with its class's bits and whether it is settled: no join
    every = met.where("times > 4").select(*place, "about", "key", "looks")
    every = every.unionByName(classes.where("n >= 4").select(*place, "bits"), allowMissingColumns=True).unionByName(settled.withColumn("done", F.lit(1)), allowMissingColumns=True)
    own = Window.partitionBy(*place)
    # the keys of its class before this one
    past = F.collect_list("key").over(own.orderBy("about").rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("past", past).withColumn("bits", F.max("bits").over(own)).withColumn("done", F.max("done").over(own)).where("key IS NOT NULL")
    with held(docs.sparkSession, _HASHES):
        every = write_stage(every, "marked")
    earlier = every.select(*_as("a_", [*place, "about", "key", "bits", "past"]))
    # sets at the threshold differ in a ninth of their sizes' sum at most
    near_bits = F.bit_count(F.col("bits").bitwiseXOR(F.col("a_bits"))) * (t + u) <= (size("about") + size("a_about")) * (u - t)
    looked_at = F.array_contains("looks", F.col(f"a_{place[0]}") if len(place) == 1 else F.struct(*[F.col(f"a_{c}").alias(c) for c in place]))
    # a pair is made under the first key that it shares, for which the filters hold if it matches
    new = ~F.coalesce(looked_at, F.lit(False)) & ~F.arrays_overlap("past", "a_past")
    far = every.where("done IS NULL").join(earlier, F.col("key") == F.col("a_key")).where(_before(place) & may_match("about", "a_about") & near_bits & new)
    far = write_stage(far.select(*pair).distinct().join(near, pair, "left_anti"), "far_pairs")
    drop_stage(met, near, every)
    late = _matching(far, classes, raw, place)
    kept = write_stage(classes.select(*place).join(settled.unionByName(late), place, "left_anti"), "kept")
    drop_stage(far, classes, settled, late)
    return kept


def _names(kept: DataFrame, place: list[str]) -> DataFrame:
    """doc_id, row and line_no from places."""
    if place != ["at"]:
        return kept
    return kept.select(F.shiftright("at", 31).alias("doc_id"), F.lit(0).cast("long").alias("row"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line_no"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no) of every line that an earlier one removes; line numbers from 0, ``row`` a hash
    of the text where doc_ids are not all different and below 2^32, or else 0."""
    place = _place(docs)
    lines = _lines(_raw(docs, place), place).where(F.ltrim("line", F.lit(_BLANK)) != "").select(*place).distinct()
    return _names(lines.join(_kept(docs, place), place, "left_anti"), place)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and n_lines and n_removed added; an input
    column of one of those names stays as it is, and the number is left out."""
    place = _place(docs)
    kept = _names(_kept(docs, place), place).groupBy("doc_id", "row").agg(F.collect_set("line_no").alias("kept"))
    rows = docs.select(F.struct(*quoted(docs)).alias("input"), F.col("doc_id"), _row(place), "text")
    # texts are not sorted for the join; rows that take no part do not meet in one task
    part = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    joined = rows.where(part).join(kept.hint("shuffle_hash"), ["doc_id", "row"], "left")
    joined = joined.withColumn("parts", F.split("text", "\n", -1))
    blank = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.ltrim(F.get("parts", i), F.lit(_BLANK)) == "")
    # explode, as above: computed once
    joined = joined.withColumn("places", F.explode(F.array(F.sort_array(F.array_union(blank, F.coalesce("kept", F.array().cast("array<int>")))))))
    n_lines, n_removed = F.size("parts"), F.size("parts") - F.size("places")
    text = F.when(n_removed == 0, F.col("text")).otherwise(F.array_join(F.transform("places", lambda i: F.get("parts", i)), "\n"))
    there = {c.lower() for c in docs.columns}

    def out(of: DataFrame, text: Column, n_lines: Column, n_removed: Column) -> DataFrame:
        columns = [text.alias(c) if c == "text" else F.col("input").getField(c).alias(c) for c in docs.columns]
        return of.select(*columns, *[v.alias(k) for k, v in {"n_lines": n_lines, "n_removed": n_removed}.items() if k not in there])

    changed = out(joined, text, n_lines, n_removed)
    aside = out(rows.where(~part), F.col("text"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), F.lit(0))
    return changed.unionByName(aside)
