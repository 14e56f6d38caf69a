"""The 34 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import lexicon
from linkloom.functions import similarity as sim
from linkloom.functions.text import literals
from linkloom.scratch import kept_out, partitions_by

# The features' names, in the order of the model's vector.
FEATURES = (
    "n_jaccard", "n_overlap", "n_ratio", "n_partial", "n_token_set", "n_token_sort", "n_charbigram", "n_jw", "n_len_ratio",
    "n_suffix_agree", "n_suffix_both", "n_nontok", "n_core_jaccard",
    "a_jaccard", "a_overlap", "a_ratio", "a_partial", "a_token_set", "a_token_sort", "a_charbigram", "a_jw", "a_len_ratio",
    "a_digit_jaccard", "a_digit_contains", "a_postal_eq", "a_state_eq", "a_state_one_sided", "a_empty_one", "a_empty_both",
    "country_eq", "key_score", "key_count", "key_count_ratio", "postal_hash_eq",
)
STRING_FEATURES = tuple(f"{side}_{kind}" for side in "na" for kind in ("ratio", "partial", "token_set", "token_sort", "jw"))


def _is(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _among(words: Column, table) -> Column:
    return F.array_intersect(words, literals(sorted(table)))


def record_side(prepared: DataFrame, side: str, *more: str) -> DataFrame:
    """A record's arrays, made once before the pair join and named by ``side`` (1 or 2), and columns ``more`` as they are."""
    legal, states = lexicon.LEGAL_FORMS, [t for t in lexicon.state_tokens() if len(t) == 2]
    rows = prepared.select(
        "entity_id", "name_norm", "addr_norm", "country", "digits", "postal", F.size("keys").alias("n_keys"),
        F.array_distinct("name_toks").alias("names"), F.array_distinct("addr_toks").alias("addrs"),
        _among(F.col("name_toks"), legal).alias("legal"), F.array_except("name_toks", literals(sorted(legal))).alias("core"),
        _among(F.col("addr_toks"), states).alias("states"), F.filter("digits", lambda d: F.length(d).isin(5, 6)).alias("postals"),
        sim.bigrams(F.col("name_norm")).alias("name_grams"), sim.bigrams(F.col("addr_norm")).alias("addr_grams"), *more,
    )
    return rows.select(*(F.col(c).alias(c if c in more else f"{c}{side}") for c in rows.columns))


def meet(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Candidate pairs with both records' columns; of these, only those in use reach the joins."""
    s1 = record_side(prepared.where("src = 1"), "1").withColumnRenamed("entity_id1", "s1_id")
    target = record_side(prepared.where("src > 1"), "2").withColumnRenamed("entity_id2", "t_id")
    return pairs.join(s1, "s1_id").join(target, "t_id")


def meet_lists(lists: DataFrame, prepared: DataFrame) -> DataFrame:
    """``meet`` for candidates in lists (``blocking.candidate_lists``), written in buckets by part (``scratch.dealt``).

    Both records' columns go to the parts that need them, each once, and meet the pairs
    there: what is shuffled are records, never pairs or lists, and records' arrays are made
    on arrival. ``hit`` tells true pairs where lists carry true targets.
    """
    # Tables dealt out by part are joined by part and id as they lie. The setting is read when
    # the result is planned, so it stays; it spares exchanges and changes no result.
    lists.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    pairs = lists.select("part", "s1_id", "carried", F.explode(F.arrays_zip("t_ids", "scores", "counts")).alias("p"))
    hit = F.coalesce(F.array_contains("carried", F.col("p.t_ids")), F.lit(False)).cast("int")
    pairs = pairs.select("part", "s1_id", F.col("p.t_ids").alias("t_id"), F.col("p.scores").alias("key_score"), F.col("p.counts").alias("key_count"), hit.alias("hit"))
    sent = lambda which, asked, name: prepared.where(which).join(kept_out(asked.withColumnRenamed(name, "entity_id")), "entity_id").repartition(partitions_by(lists, "part"), "part")
    s1 = record_side(sent("src = 1", lists.select("part", "s1_id"), "s1_id"), "1", "part").withColumnRenamed("entity_id1", "s1_id")
    target = record_side(sent("src > 1", lists.select("part", F.explode("t_ids").alias("t_id")).distinct(), "t_id"), "2", "part").withColumnRenamed("entity_id2", "t_id")
    # A part has few records of source 1, so their side of a join fits in memory.
    return pairs.join(kept_out(target), ["t_id", "part"]).join(s1.hint("shuffle_hash"), ["part", "s1_id"]).drop("part")


def expressions() -> dict[str, Column]:
    """The features that are Column expressions over ``meet``'s columns."""
    c = F.col
    empty1, empty2 = c("addr_norm1") == "", c("addr_norm2") == ""
    no_core = (F.size("core1") == 0) & (F.size("core2") == 0)
    no_legal = (F.size("legal1") == 0) & (F.size("legal2") == 0)
    inside = F.size(F.array_intersect("digits1", "digits2")) == F.least(F.size("digits1"), F.size("digits2"))
    jaccard = sim.jaccard(c("names1"), c("names2"))
    return {
        "n_jaccard": jaccard,
        "n_overlap": sim.overlap(c("names1"), c("names2")),
        "n_charbigram": sim.bigram_overlap(c("name_grams1"), c("name_grams2")),
        "n_len_ratio": sim.length_ratio(c("name_norm1"), c("name_norm2")),
        "n_suffix_agree": F.when(no_legal, 1.0).otherwise(sim.jaccard(c("legal1"), c("legal2"))),
        "n_suffix_both": _is((F.size("legal1") > 0) & (F.size("legal2") > 0)),
        "n_nontok": _is((F.size("names1") == 0) & (F.size("names2") == 0)),
        "n_core_jaccard": F.when(no_core, jaccard).otherwise(sim.jaccard(c("core1"), c("core2"))),
        "a_jaccard": sim.jaccard(c("addrs1"), c("addrs2")),
        "a_overlap": sim.overlap(c("addrs1"), c("addrs2")),
        "a_charbigram": sim.bigram_overlap(c("addr_grams1"), c("addr_grams2")),
        "a_len_ratio": sim.length_ratio(c("addr_norm1"), c("addr_norm2")),
        "a_digit_jaccard": sim.jaccard(c("digits1"), c("digits2")),
        "a_digit_contains": _is((F.size("digits1") > 0) & (F.size("digits2") > 0) & inside),
        "a_postal_eq": _is(F.arrays_overlap("postals1", "postals2")),
        "a_state_eq": _is(F.arrays_overlap("states1", "states2")),
        "a_state_one_sided": _is(F.array_sort("states1") != F.array_sort("states2")),
        "a_empty_one": _is(empty1 != empty2),
        "a_empty_both": _is(empty1 & empty2),
        "country_eq": _is(c("country1") == c("country2")),
        "key_score": c("key_score").cast("double"),
        "key_count": c("key_count").cast("double"),
        "key_count_ratio": c("key_count") / F.greatest("n_keys1", "n_keys2", F.lit(1)),
        "postal_hash_eq": _is((c("postal1") != 0) & (c("postal1") == c("postal2"))),
    }


def string_features(met: DataFrame, kinds: tuple[str, ...] = tuple(sim.KERNELS)) -> DataFrame:
    """Adds the string scores ``kinds`` of names and addresses, ten if all. An address score is 1 if both are empty and 0 if one is.

    Companies of one name have many pairs in a row, so names' scores are remembered.
    """
    scored = met.withColumn("_n", sim.string_scores("name_norm1", "name_norm2", kinds, True)).withColumn("_a", sim.string_scores("addr_norm1", "addr_norm2", kinds))
    empty1, empty2 = F.col("addr_norm1") == "", F.col("addr_norm2") == ""
    for kind in kinds:
        scored = scored.withColumn(f"n_{kind}", F.col(f"_n.{kind}"))
        scored = scored.withColumn(f"a_{kind}", F.when(empty1 & empty2, 1.0).when(empty1 | empty2, 0.0).otherwise(F.col(f"_a.{kind}")))
    return scored.drop("_n", "_a")


def pair_features(pairs: DataFrame, prepared: DataFrame, *more: str) -> DataFrame:
    """``s1_id, t_id``, the 34 features as doubles and columns ``more`` as they are; ``pairs`` may be written lists as well."""
    met = meet_lists(pairs, prepared) if "t_ids" in pairs.columns else meet(pairs, prepared)
    scored, made = string_features(met), expressions()
    return scored.select("s1_id", "t_id", *((made[f] if f in made else F.col(f)).cast("double").alias(f) for f in FEATURES), *more)
