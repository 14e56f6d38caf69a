"""Order MinHash fingerprints, built from Spark's own functions only.

A text's k-mers (runs of ``width`` words) are numbered by their occurrence and hashed as
(k-mer, occurrence). The sketch's orders come from independent hashes of these, four of
each (by all bits or the lower half of them, upwards or downwards). The ``length`` first
k-mers under an order are put back in text order and hashed as one tuple. Equal entries of
two sketches estimate how alike the texts are in content and order, which tracks their edit
distance.

All steps are linear in a text's words; only texts that repeat a k-mer are sorted, for the
occurrence numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import materialise

#: Words in a k-mer, k-mers in a tuple, orders in a sketch (four a hash).
WIDTH, LENGTH, ORDERS = 5, 2, 32
#: Characters after which a longer word is cut into several, so that text without spaces has k-mers as well.
WORD = 32


def _let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: the plan would repeat it otherwise."""
    return F.get(F.transform(F.array(value), body), 0)


def kmer_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hash of each run of ``width`` words; a shorter text is one run, an empty one has none."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.least(F.size(h), F.lit(1)))),
        lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, width))),
    )
    return _let(hashed, runs)


def numbered(kmers: Column) -> Column:
    """Hash of each k-mer and its occurrence number, in text order; the first occurrence keeps the k-mer's own.

    Most texts repeat no k-mer. Else sorting (hash, position)
    brings equal k-mers together in text order; where a run of them starts, its slice
    numbers its members, and they go back to their positions.
    """

    def runs(k: Column) -> Column:
        pairs = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def number(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, i - 1)["h"]))
            found = _let(
                starts,
                lambda at: F.flatten(F.transform(at, lambda a, r: F.transform(
                    F.slice(s, a + 1, F.coalesce(F.get(at, r + 1), F.size(s)) - a), lambda x, n: F.struct(x["p"].alias("p"), F.when(n == 0, x["h"]).otherwise(F.xxhash64(x["h"], n)).alias("h"))
                ))),
            )
            return F.transform(F.sort_array(found), lambda x: x["h"])

        return _let(pairs, number)

    return _let(kmers, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), k).otherwise(runs(k)))


def sketch(text: Column, width: int = WIDTH, length: int = LENGTH, orders: int = ORDERS) -> Column:
    """The fingerprint's entries (32 bits each), ``orders`` rounded up to four a hash. Empty without a word.

    A hash gives four orders: its values from the least up and from the greatest down, and
    the values of its lower 32 bits likewise.
    """

    def entry(ranks: Column, taken: list[Column]) -> Column:
        placed = F.transform(F.array_compact(F.array(*taken)), lambda h: F.struct(F.array_position(ranks, h).alias("p"), h.alias("h")))
        return F.shiftright(F.xxhash64(F.transform(F.sort_array(placed), lambda x: x["h"])), 32).cast("int")

    def order(ranks: Column, first, rest: Column | None = None, taken: tuple[Column, ...] = ()) -> Column:
        """``first`` (least or greatest) is taken ``length`` times."""
        if len(taken) == length:
            return entry(ranks, list(taken))
        rest = ranks if rest is None else rest
        return _let(first(rest), lambda h: order(ranks, first, F.array_remove(rest, h), (*taken, h)))

    both = lambda ranks: [order(ranks, F.array_min), order(ranks, F.array_max)]

    def four(ranks: Column) -> Column:
        return _let(F.transform(ranks, lambda h: F.shiftleft(h, 32)), lambda lower: F.array(*both(ranks), *both(lower)))

    def entries(kmers: Column) -> Column:
        # The k-mers' own hashes give the first four orders.
        more = -(-orders // 4) - 1
        again = F.transform(F.sequence(F.lit(1), F.lit(more)), lambda i: _let(F.transform(kmers, lambda h: F.xxhash64(h, i)), four))
        return F.concat(four(kmers), F.flatten(again)) if more else four(kmers)

    none = F.array().cast("array<int>")
    return _let(numbered(kmer_hashes(text, width)), lambda k: F.when(F.size(k) == 0, none).otherwise(entries(k)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries, 0 to 1; two empty sketches are alike, one empty one is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / F.size(a)).cast("double")


def spelled(entries: Column) -> Column:
    """The entries in hex, in the orders' order."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def successors(ids: DataFrame, parts: int) -> DataFrame:
    """``doc_id, next_id`` over distinct ids in ascending order; the last is followed by the first.

    Ids are dealt out by ranges; only each range's smallest id meets the others.
    """
    ranged = materialise(ids.repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("part")), "id-ranges")
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head")).withColumn(
        "after", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy()))
    )
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(F.broadcast(heads), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def fingerprint(docs: DataFrame, width: int = WIDTH, length: int = LENGTH, orders: int = ORDERS) -> DataFrame:
    """``doc_id, text, n_chars, sketch`` of each document (null text: empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).cast("long").alias("n_chars"), sketch(text, width, length, orders).alias("sketch"))


def compare_edited(docs: DataFrame, width: int = WIDTH, length: int = LENGTH, orders: int = ORDERS, texts: bool = True) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text replaces the last ``floor(n_chars / 2)`` characters by the first as
    many (or all) of the next document, by ascending ``doc_id``; the first follows the
    last. Of rows that share an id the one with the smallest hash of its text is the next
    document of the id before. A null ``doc_id`` has no place in the order: it is given
    back with its own fingerprint, followed by an empty document. A null text is empty,
    very long texts are sketched whole (a word of over 32 characters counts as several),
    repeated rows are kept, other columns are ignored, an empty table gives no rows.

    Returns ``doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited,
    near_next``, and ``text, edited`` with ``texts``.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A cast that changes nothing would still make the two uses of these rows differ in the
    # plan, and the exchange below would not be reused.
    number = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(number, F.coalesce("text", F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    # Of each id its smallest text's hash, and how many characters it asks of the next.
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("h"), F.max(F.length("text")).alias("n"))
    ids = materialise(ids, "ids")
    order = successors(ids.select("doc_id"), parts)
    asked = order.join(ids.select("doc_id", F.floor(F.col("n") / 2).cast("int").alias("need")), "doc_id").select(F.col("doc_id").alias("asker"), "next_id", "need")
    asked = materialise(asked.join(ids.select(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h")), "next_id"), "asked")
    # Texts are dealt out by id once: lending and editing read the same exchange, so the
    # text's hash must not become a second join key.
    named = rows.where("doc_id IS NOT NULL")
    chosen = (F.col("doc_id") == F.col("next_id")) & (digest.bitwiseXOR(F.col("next_h")) == 0)
    lent = named.join(asked, chosen).select("asker", F.expr("substr(text, 1, need)").alias("lent")).groupBy("asker").agg(F.first("lent").alias("lent"))
    half = F.expr("cast(floor(length(text) / 2) as int)")
    edited = F.concat(F.expr("substr(text, 1, cast(length(text) - floor(length(text) / 2) as int))"), F.coalesce(F.substr("lent", F.lit(1), half), F.lit("")))
    met = named.join(lent, F.col("doc_id") == F.col("asker"), "left").select("doc_id", "text", "lent")
    met = met.unionByName(rows.where("doc_id IS NULL").withColumn("lent", F.lit(None).cast("string"))).withColumn("edited", edited)
    met = materialise(
        met.select(
            "doc_id", digest.alias("h"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
            sketch(F.col("text"), width, length, orders).alias("sketch"), sketch(F.col("edited"), width, length, orders).alias("edited_sketch"), *(["text", "edited"] if texts else []),
        ),
        "sketches",
    )
    # Only sketches travel from here on.
    one = met.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id"), F.col("h").alias("next_h")).agg(F.first("sketch").alias("next_sketch"))
    following = asked.join(one, ["next_id", "next_h"]).select("asker", "next_sketch")
    both = met.join(following, F.col("doc_id") == F.col("asker"), "left").withColumn("next_sketch", F.coalesce("next_sketch", F.array().cast("array<int>")))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), *(["text", "edited"] if texts else []),
    )
