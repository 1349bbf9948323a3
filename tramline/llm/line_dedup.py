"""Near-duplicate lines by a deletion-neighbourhood join, in built-in functions.

Two lines are near when one word inserted, deleted or replaced turns one into the
other. A line emits, as hashed keys, itself and all variants with one word deleted:
lines that differ by a replacement share the variant without that word, lines that
differ by a deletion share the longer one's variant and the shorter one itself. Equal
keys meet; each line is paired with the earliest only of those near by that key, and the
pair is verified word by word. Lines that share the place and the variant of a
replacement are all near; of those that share a shorter line, the longer ones are near to
it but not always to each other, so they meet the line itself, and it meets the earliest.

Near lines also share their first or their second half, so only lines that share a
half with another line emit variants. Variants are hashed by running exclusive-ors
over the words, in time linear in the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.bloom import BlockedBloom
from tramline.session import written

MIN_WORDS = 5
_SPACES = r"[\x20\x09-\x0D]+"


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that has words: where it stands, its words parted by one space,
    two hashes of them."""
    plain = F.trim("line")
    odd = F.contains(plain, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(plain, F.lit(c))
    norm = F.when(odd, F.trim(F.regexp_replace("line", _SPACES, " "))).otherwise(plain)
    return (rows.select("id", "r", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .select("id", "r", "line_no", norm.alias("norm")).where("norm <> ''")
            .select("id", "r", "line_no", "norm", F.xxhash64("norm").alias("h"),
                    F.xxhash64("norm", F.lit("second")).alias("g")))


def _halves(words: Column) -> Column:
    """Hashes of the first and second halves. A near line may have one word less or more,
    so the halves are taken for the length of the shorter one, if that is this line and
    if it is not."""
    n = F.size(words)
    keys = []
    for shorter in (n - 1, n):
        first = F.floor(shorter / 2).cast("int")
        second = shorter - first
        keys += [F.xxhash64(F.lit("first"), shorter, F.slice(words, F.lit(1), first)),
                 F.xxhash64(F.lit("second"), shorter, F.slice(words, n - second + 1, second))]
    return F.array(*keys)


def _near(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced turns a into b."""
    longer, shorter = (F.when(F.size(a) >= F.size(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    size = F.size(shorter)
    differ = F.array_position(F.zip_with(F.slice(longer, F.lit(1), size), shorter, lambda x, y: x != y), True)
    at = F.when(differ == 0, size + 1).otherwise(differ.cast("int"))  # the first word that differs, from 1
    rest = F.slice(longer, at + 1, size + 1)
    return F.when(F.size(longer) == size, rest == F.slice(shorter, at + 1, size + 1)) \
        .when(F.size(longer) == size + 1, rest == F.slice(shorter, at, size + 1)).otherwise(False)


def _variants(lines: DataFrame) -> DataFrame:
    """The keys of each line's deletion neighbourhood; whether a key stands for the line
    itself (plain) or for the line less a word (shorter). If it shares only first halves, the
    word that differs is in the second half, and so the other way round."""
    words = lines.select("h", "g", "first", "in_first", "in_second", F.size("words").alias("n"),
                         F.posexplode("words").alias("i", "word"))
    whole = Window.partitionBy("h", "g")
    so_far = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.xxhash64("word", "i"), F.xxhash64("word", F.col("i") - 1)
    rows = words.withColumns({"x": x, "y": y}).drop("word").withColumns({
        "full": F.bit_xor("x").over(whole), "before": F.bit_xor("x").over(so_far),
        "moved": F.bit_xor("y").over(so_far), "all_moved": F.bit_xor("y").over(whole)})
    # Words before i in place, words after i moved up by one.
    variant = F.col("before").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("all_moved")).bitwiseXOR(F.col("moved"))
    middle = F.floor((F.col("n") - 1) / 2)
    asked = (F.col("in_first") & (F.col("i") <= middle)) | (F.col("in_second") & (F.col("i") >= middle))

    def key(hashed: Column, plain: bool, shorter: bool) -> Column:
        return F.struct(hashed.alias("key"), F.lit(plain).alias("plain"), F.lit(shorter).alias("shorter"))

    keys = F.array_compact(F.array(
        F.when(asked, key(F.xxhash64(F.lit("replaced"), "n", "i", variant), False, False)),
        F.when(asked, key(F.xxhash64(F.lit("line"), F.col("n") - 1, variant), False, True)),
        F.when(F.col("i") == 0, key(F.xxhash64(F.lit("line"), "n", "full"), True, False))))
    return rows.select("h", "g", "first", F.explode(keys).alias("k")).select("h", "g", "first", "k.*")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: id_col, n_lines, n_removed (long), removed (array of line
    numbers from 0).

    Lines end at a line feed; runs of ASCII white space count as one space. A line goes
    if an earlier one (by id, then line number; null ids first) is equal or, for lines of
    at least ``min_words`` words, near. Lines without words stay. Null texts count as one
    empty line. Rows with the same id and text count as one; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("r", F.xxhash64("text"))
    lines = _lines(rows)
    place = F.struct("id", "line_no", "r")
    words = F.split("norm", " ")
    # Of lines with too few words the halves are null.
    halved = lines.select("h", "g", place.alias("place"), words.alias("words")).select(
        "h", "g", "place", F.when(F.size("words") >= min_words, _halves(F.col("words"))).alias("k"))
    different = written(
        halved.groupBy("h", "g").agg(F.min("place").alias("first"), *(
            F.min(F.get("k", F.lit(i))).alias(f"k{i}") for i in range(4))), "lines")
    key = F.explode(F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(i % 2 == 1).alias("second"))
                              for i in range(4))))
    keyed = different.where("k0 IS NOT NULL").select("h", key.alias("k")).select("h", "k.*")
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    some = (keyed.join(shared, "key", "left_semi").groupBy("h")
            .agg(F.bool_or("second").alias("in_first"), F.bool_or(~F.col("second")).alias("in_second")))
    some = written(some.join(different.select("h", "g", "first"), "h"), "candidates")
    texts = written(BlockedBloom(some, "h").possible(lines.select("h", "g", "norm"), "h").join(some, ["h", "g"])
                    .dropDuplicates(["h", "g"]).withColumn("words", words).drop("norm"), "texts")
    variants = _variants(texts)
    line = F.struct("first", "h", "g")
    low = variants.groupBy("key").agg(F.min(F.when(F.col("plain"), line)).alias("low_plain"),
                                      F.min(F.when(~F.col("plain"), line)).alias("low_variant"))
    pairs = (variants.join(low, "key")
             .withColumn("low", F.when(F.col("shorter"), F.col("low_plain")).otherwise(F.col("low_variant")))
             .where("low.first < first")
             .select("h", "g", F.col("low.h").alias("low_h"), F.col("low.g").alias("low_g")).distinct())
    a, b = texts.select("h", "g", F.col("words").alias("own")), texts.select(
        F.col("h").alias("low_h"), F.col("g").alias("low_g"), F.col("words").alias("low"))
    near = (pairs.join(a, ["h", "g"]).join(b, ["low_h", "low_g"])
            .where(_near(F.col("own"), F.col("low"))).select("h", "g", F.lit(True).alias("near")).distinct())
    judged = different.select("h", "g", "first").join(near, ["h", "g"], "left")
    removed = (lines.select("id", "r", "line_no", "h", "g").join(judged, ["h", "g"])
               .where(F.col("near").isNotNull() | ~place.eqNullSafe(F.col("first")))
               .groupBy("id", "r").agg(F.sort_array(F.collect_set("line_no")).alias("removed")))
    k, m = rows.select("id", "r", F.size(F.split("text", "\n")).cast("long").alias("n_lines")).alias("k"), removed.alias("m")
    gone = F.coalesce("m.removed", F.array().cast("array<int>"))
    return (k.join(m, F.col("k.id").eqNullSafe(F.col("m.id")) & (F.col("k.r") == F.col("m.r")), "left")
            .select(F.col("k.id").alias(id_col), "k.n_lines", F.size(gone).cast("long").alias("n_removed"),
                    gone.alias("removed")))


def without(text: Column, removed: Column) -> Column:
    """A text without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i)), "\n")
