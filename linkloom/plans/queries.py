"""The registered linkage queries; each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import LinkConfig
from linkloom.functions import text
from linkloom.operators import blocking, features, keys, labels, metrics, model, output, validate
from linkloom.plans import link
from linkloom.plans.link import Prepared
from linkloom.scratch import dealt, materialise, scratch_path
from linkloom.sources import projections as proj
from linkloom.sources import tables
from linkloom.sources.tables import explode_lists, normalise

Query = Callable[[SparkSession, str], DataFrame]
#: Every query runs with the production parameters.
CFG = LinkConfig()
GRID = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(words, sep: str = " "):
    return F.array_join(words, sep)


def companies(spark: SparkSession, d: str) -> DataFrame:
    return proj.company_records(spark, d)


def prepared(spark: SparkSession, d: str) -> Prepared:
    """The company records with their keys, written once for each query that reads them."""
    return link.prepare(companies(spark, d), CFG)


def s1_ids(spark: SparkSession, d: str) -> DataFrame:
    return link.source_ids(companies(spark, d))


def chosen_keys(p: Prepared, cfg: LinkConfig = CFG) -> DataFrame:
    return blocking.rarest_keys(p.keys, blocking.key_df(p.keys), cfg)


def company_postings(p: Prepared, cfg: LinkConfig = CFG) -> DataFrame:
    return blocking.posting_join(chosen_keys(p, cfg), p.keys)


def company_pairs(p: Prepared, cfg: LinkConfig = CFG, counted: bool = True) -> DataFrame:
    return blocking.all_pairs(p.keys, cfg, p.n_targets, counted)


def company_candidates(spark: SparkSession, d: str) -> DataFrame:
    return link.candidates(prepared(spark, d), CFG)


def company_lists(spark: SparkSession, d: str) -> DataFrame:
    """The candidates in lists, and beside them their record's true targets."""
    return link.candidate_lists(prepared(spark, d), CFG, proj.company_truth(spark, d))


def company_meet(spark: SparkSession, d: str) -> DataFrame:
    p = prepared(spark, d)
    return features.meet_lists(dealt(link.candidate_lists(p, CFG, proj.company_truth(spark, d)), "listed", "part"), p.records)


def some_features(spark: SparkSession, d: str, *names: str) -> DataFrame:
    made = features.expressions()
    return company_meet(spark, d).select("s1_id", "t_id", *(F.round(made[n], 6).alias(n) for n in names))


def plain_scores(spark: SparkSession, d: str) -> DataFrame:
    """``s1_id, t_id, score, hit``: a mean of four features, which SQL can follow, and whether the pair is true."""
    f = features.expressions()
    total = f["n_jaccard"] + f["n_overlap"] + f["a_jaccard"] + f["a_overlap"]
    return company_meet(spark, d).select("s1_id", "t_id", F.round(total / 4, 6).alias("score"), "hit")


# --- tables ------------------------------------------------------------------------------


def company_files(spark: SparkSession, d: str) -> str:
    """The company records as tab-separated files in a scratch folder."""
    folder = scratch_path(spark, "companies")
    companies(spark, d).select(*tables.COLUMNS).write.csv(folder, sep="\t", header=True, quote="", emptyValue="", nullValue="")
    return folder


def truth_files(spark: SparkSession, d: str) -> str:
    folder = scratch_path(spark, "truth")
    output.write_lists(output.id_lists(s1_ids(spark, d), proj.company_truth(spark, d), "matched_entity_ids"), folder)
    return folder


@query
def scan_source(spark, d):
    rows = tables.read_source(spark, company_files(spark, d))
    return rows.select(F.col("src").cast("int").alias("src"), *tables.COLUMNS)


@query
def scan_columns(spark, d):
    return tables.read_source(spark, company_files(spark, d)).select("entity_id", "country")


@query
def scan_ids(spark, d):
    return tables.read_ids(spark, company_files(spark, d))


@query
def scan_truth(spark, d):
    return tables.read_truth(spark, truth_files(spark, d))


@query
def normalised_store(spark, d):
    """The normalised form, written once and read by column; a second write finds it there."""
    path = scratch_path(spark, "normalised")
    for _ in range(2):
        tables.write_normalised(companies(spark, d), path)
    return tables.read_normalised(spark, path, "entity_id", "addr_norm")


@query
def normalised_rows(spark, d):
    n = tables.write_normalised(companies(spark, d), scratch_path(spark, "normalised"))
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query
def result_file(spark, d):
    return spark.read.option("header", False).text(truth_files(spark, d)).where(~F.col("value").startswith("source1_entity_id"))


@query
def metrics_file(spark, d):
    path = scratch_path(spark, "recall")
    tables.write_metrics(candidate_recall(spark, d), path)
    return tables.read_metrics(spark, path).select("true_pairs", "hits", "recall", "mean_candidates")


@query
def known_truth(spark, d):
    """Truth with ids that no table has; these go."""
    truth = proj.company_truth(spark, d)
    other = truth.select("s1_id", F.concat("t_id", F.lit("x")).alias("t_id")).unionByName(truth.select(F.concat("s1_id", F.lit("x")).alias("s1_id"), "t_id"))
    return tables.known_truth(truth.unionByName(other), companies(spark, d))


# --- text ------------------------------------------------------------------------------


def whole_texts(spark, d):
    return proj.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query
def norm_text(spark, d):
    return whole_texts(spark, d).select("doc_id", text.norm_text(F.col("text")).alias("norm"))


@query
def strip_accents(spark, d):
    return whole_texts(spark, d).select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query
def transliterate(spark, d):
    """Whole texts with some letters replaced by Cyrillic ones, read back as Latin."""
    cyrillic = F.translate("text", "".join(proj.CYRILLIC), "".join(proj.CYRILLIC.values()))
    return whole_texts(spark, d).select("doc_id", text.norm_text(cyrillic, True).alias("norm"))


@query
def ascii_flag(spark, d):
    return proj.table(spark, d, "documents").select("doc_id", text.is_ascii(F.col("text")).alias("ascii"))


@query
def tokens(spark, d):
    rows = normalise(companies(spark, d), False)
    toks = text.tokens(F.col("name_norm"))
    return rows.select("entity_id", joined(toks).alias("toks"), F.size(toks).alias("n"))


@query
def multiword(spark, d):
    rows = normalise(companies(spark, d), False)
    return rows.select("entity_id", joined(text.merge_phrases(text.tokens(F.col("addr_norm")))).alias("toks"))


@query
def multiword_compat(spark, d):
    rows = normalise(companies(spark, d), False)
    return rows.select("entity_id", joined(text.merge_phrases(text.tokens(F.col("addr_norm")), True)).alias("toks"))


@query
def name_tokens(spark, d):
    return prepared(spark, d).records.select("entity_id", joined("name_toks").alias("toks"))


@query
def addr_tokens(spark, d):
    return prepared(spark, d).records.select("entity_id", joined("addr_toks").alias("toks"))


@query
def addr_tokens_split_states(spark, d):
    rows = normalise(companies(spark, d), False)
    return rows.select("entity_id", joined(text.addr_tokens(F.col("addr_norm"), True)).alias("toks"))


@query
def addr_without_noise(spark, d):
    return prepared(spark, d).records.select("entity_id", joined(text.without_noise(F.col("addr_toks"))).alias("toks"))


@query
def name_specific(spark, d):
    return prepared(spark, d).records.select("entity_id", joined(text.without_generic(F.col("name_toks"))).alias("toks"))


@query
def numeric_tokens(spark, d):
    rows = normalise(companies(spark, d), False)
    return rows.select("entity_id", joined(text.numeric_tokens(F.col("addr_norm")), ",").alias("runs"), text.digit_concat(F.col("addr_norm")).alias("digits"))


@query
def digit_signature(spark, d):
    return normalise(companies(spark, d), False).select("entity_id", text.digit_signature(F.col("addr_norm")).alias("sig"))


@query
def postal(spark, d):
    return prepared(spark, d).records.select("entity_id", "postal")


@query
def country_code(spark, d):
    return companies(spark, d).select("entity_id", text.country_code(F.col("country")).alias("code"))


# --- keys and candidates -----------------------------------------------------------------


@query
def blocking_keys(spark, d):
    return prepared(spark, d).keys


@query
def key_count(spark, d):
    return prepared(spark, d).records.select("entity_id", F.size("keys").alias("n_keys")).where("n_keys > 0")


@query
def key_class_hist(spark, d):
    return prepared(spark, d).keys.groupBy("src", "key_class").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_distinct"))


@query
def key_df(spark, d):
    return blocking.key_df(prepared(spark, d).keys)


@query
def key_rarest(spark, d):
    return chosen_keys(prepared(spark, d))


@query
def df_hard_cap(spark, d):
    return chosen_keys(prepared(spark, d), LinkConfig(hard_cap=5))


@query
def df_soft_cap(spark, d):
    return chosen_keys(prepared(spark, d), LinkConfig(soft_cap=5))


@query
def posting_join(spark, d):
    return company_postings(prepared(spark, d))


@query
def idf(spark, d):
    p = prepared(spark, d)
    return blocking.key_df(p.keys).select("key", F.round(blocking.idf(F.col("df"), F.lit(p.n_targets)), 6).alias("idf"))


@query
def shared_count(spark, d):
    return company_pairs(prepared(spark, d)).select("s1_id", "t_id", "key_count")


@query
def key_score(spark, d):
    return company_pairs(prepared(spark, d), counted=False).select("s1_id", "t_id", "key_score")


@query
def min_shared(spark, d):
    return company_pairs(prepared(spark, d), LinkConfig(min_shared=3)).select("s1_id", "t_id", "key_count")


@query
def top_m(spark, d):
    return company_candidates(spark, d)


@query
def link_documents(spark, d):
    """The flagship: candidates of the records made from documents."""
    return link.candidates(link.prepare(proj.document_records(spark, d), CFG), CFG)


@query
def document_recall(spark, d):
    records = proj.document_records(spark, d)
    truth = proj.document_truth(records)
    return metrics.list_recall(link.candidate_lists(link.prepare(records, CFG), CFG, truth), truth, link.source_ids(records))


@query
def mean_candidates(spark, d):
    pairs = company_candidates(spark, d).groupBy("s1_id").agg(F.count("*").alias("n"))
    met = s1_ids(spark, d).join(pairs, "s1_id", "left").select("s1_id", F.coalesce("n", F.lit(0)).alias("n"))
    return met.agg(F.count("*").alias("records"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query
def records_with_candidates(spark, d):
    return company_candidates(spark, d).select("s1_id").distinct()


@query
def truth_pairs(spark, d):
    lists = output.id_lists(s1_ids(spark, d), proj.company_truth(spark, d), "matched_entity_ids")
    return explode_lists(lists)


@query
def candidate_recall(spark, d):
    return metrics.list_recall(company_lists(spark, d), proj.company_truth(spark, d), s1_ids(spark, d))


# --- features ----------------------------------------------------------------------------


@query
def f_jaccard(spark, d):
    return some_features(spark, d, "n_jaccard", "a_jaccard")


@query
def f_overlap(spark, d):
    return some_features(spark, d, "n_overlap", "a_overlap")


@query
def f_core_jaccard(spark, d):
    return some_features(spark, d, "n_core_jaccard")


@query
def f_suffix(spark, d):
    return some_features(spark, d, "n_suffix_agree", "n_suffix_both", "n_nontok")


@query
def f_len_ratio(spark, d):
    return some_features(spark, d, "n_len_ratio", "a_len_ratio")


@query
def f_bigram(spark, d):
    return some_features(spark, d, "n_charbigram", "a_charbigram")


@query
def f_digits(spark, d):
    return some_features(spark, d, "a_digit_jaccard", "a_digit_contains")


@query
def f_postal(spark, d):
    return some_features(spark, d, "a_postal_eq", "postal_hash_eq")


@query
def f_state(spark, d):
    return some_features(spark, d, "a_state_eq", "a_state_one_sided")


@query
def f_empty(spark, d):
    return some_features(spark, d, "a_empty_one", "a_empty_both")


@query
def f_country(spark, d):
    return some_features(spark, d, "country_eq")


@query
def f_key_ratio(spark, d):
    return some_features(spark, d, "key_score", "key_count", "key_count_ratio")


@query
def f_jaro_winkler(spark, d):
    scored = features.string_features(company_meet(spark, d), ("jw",))
    return scored.select("s1_id", "t_id", F.round("n_jw", 6).alias("n_jw"), F.round("a_jw", 6).alias("a_jw"))


@query
def f_fuzz_ratios(spark, d):
    scored = features.string_features(company_meet(spark, d), tuple(k for k in features.sim.KERNELS if k != "jw"))
    return scored.select("s1_id", "t_id", *(F.round(f, 6).alias(f) for f in features.STRING_FEATURES if not f.endswith("jw")))


def all_features(spark, d):
    p = prepared(spark, d)
    return link.featured(p, CFG)


@query
def pair_features(spark, d):
    return all_features(spark, d).select("s1_id", "t_id", *(F.round(f, 6).alias(f) for f in features.FEATURES))


@query
def plain_features(spark, d):
    """The 26 of the 34 features that SQL can follow."""
    return pair_features(spark, d).drop(*(f for f in features.STRING_FEATURES if not f.endswith("jw")))


# --- labels, metrics, model ---------------------------------------------------------------


@query
def label_pairs(spark, d):
    return labels.label_lists(company_lists(spark, d), CFG).select("s1_id", "t_id", "label")


@query
def positives(spark, d):
    return labels.positives(company_candidates(spark, d), proj.company_truth(spark, d))


@query
def split_by_hash(spark, d):
    return s1_ids(spark, d).select("s1_id", labels.split_of(F.col("s1_id"), CFG).alias("split"))


@query
def split_counts(spark, d):
    return labels.split_counts(labels.label_pairs(company_candidates(spark, d), proj.company_truth(spark, d), CFG))


def plain_counts(spark, d):
    found = output.matches(plain_scores(spark, d), 0.6)
    return metrics.record_counts(s1_ids(spark, d), proj.company_truth(spark, d), found)


@query
def threshold_filter(spark, d):
    return output.matches(plain_scores(spark, d), 0.6).drop("hit")


@query
def f05_entity(spark, d):
    return metrics.record_f05(plain_counts(spark, d))


@query
def f05_macro(spark, d):
    return metrics.macro_f05(plain_counts(spark, d)).select("records", "macro_f05")


@query
def error_buckets(spark, d):
    return metrics.macro_f05(plain_counts(spark, d)).select("perfect", "missed", "fp_only")


@query
def threshold_sweep(spark, d):
    return metrics.threshold_sweep(plain_scores(spark, d), proj.company_truth(spark, d), s1_ids(spark, d), GRID)


@query
def best_threshold(spark, d):
    return metrics.best_threshold(threshold_sweep(spark, d))


@query
def top1_policy(spark, d):
    return metrics.top_one(plain_scores(spark, d).drop("hit"))


@query
def match_lists(spark, d):
    return output.id_lists(s1_ids(spark, d), output.matches(plain_scores(spark, d), 0.6), "matched_entity_ids")


@query
def candidate_lists(spark, d):
    return output.joined_lists(link.candidate_lists(prepared(spark, d), CFG), "candidate_entity_ids")


@query
def gbt_scores(spark, d):
    rows = materialise(all_features(spark, d), "featured")
    fitted, _ = link.train(companies(spark, d), proj.company_truth(spark, d), CFG, pairs=rows)
    return model.predict(fitted, rows)


@query
def model_reload(spark, d):
    """How many scores change when the model is saved and loaded: none."""
    p = prepared(spark, d)
    pairs = materialise(link.candidates(p, CFG), "pairs")
    rows = features.meet(pairs, p.records).select("s1_id", "t_id", *(f.alias(n) for n, f in features.expressions().items()))
    rows = materialise(rows.select("s1_id", "t_id", *(F.coalesce(F.col(f), F.lit(0.0)).alias(f) if f in rows.columns else F.lit(0.0).alias(f) for f in features.FEATURES)), "plain")
    fitted = model.fit(materialise(labels.label_pairs(rows, proj.company_truth(spark, d), LinkConfig(train_share=50, val_share=50)), "labelled"), rounds=3)
    path = scratch_path(spark, "model")
    model.save(fitted, path, 0.5)
    again = model.predict(model.load(path), rows).withColumnRenamed("score", "again")
    met = model.predict(fitted, rows).join(again, ["s1_id", "t_id"])
    return met.agg(F.count("*").alias("pairs"), F.count_if(F.col("score") != F.col("again")).alias("changed"), F.lit(model.load_threshold(path)).alias("threshold"))


@query
def infer_lists(spark, d):
    """Training and inference from the records to both lists; of the pairs, only those that train are written."""
    p, truth = prepared(spark, d), proj.company_truth(spark, d)
    lists = dealt(link.candidate_lists(p, CFG, truth), "listed", "part")
    fitted, threshold = link.train_lists(lists, p, truth, CFG)
    return link.infer_lists(lists, p, fitted, threshold)


# --- validation ----------------------------------------------------------------------------


def broken_lists(spark, d):
    """Lists that break each rule somewhere: ``s1_id, ids``."""
    c = F.col("c_custkey")
    own = F.array_compact(F.array(
        F.when(c % 10 < 7, F.concat(F.lit("S2-"), c)), F.when(c % 10 < 4, F.concat(F.lit("S3-"), c)), F.when(c % 19 == 0, F.concat(F.lit("S2-"), c)),
        F.when(c % 23 == 0, F.concat(F.lit("S1-"), c)), F.when(c % 29 == 0, F.concat(F.lit("X9-"), c)), F.when(c % 31 == 0, F.concat(F.lit("S2-9999"), c)),
    ))
    times = F.when(c % 37 == 0, 0).when(c % 17 == 0, 2).otherwise(1)
    rows = proj.table(spark, d, "customer").select(F.concat(F.lit("S1-"), c).alias("source1_entity_id"), joined(own, ",").alias("matched_entity_ids"), F.explode(F.array_repeat(F.lit(1), times)).alias("n")).drop("n")
    extra = proj.table(spark, d, "supplier").select(F.concat(F.lit("S1-x"), "s_suppkey").alias("source1_entity_id"), F.lit("").alias("matched_entity_ids"))
    return validate.lists_of(rows.unionByName(extra), "matched_entity_ids")


def target_ids(spark, d):
    return companies(spark, d).where("src > 1").select(F.col("entity_id").alias("t_id"))


def line_file(spark, d, *first: str) -> str:
    """A file of lists that begins with the lines ``first``; each thirteenth customer's line has no tab."""
    folder, c = scratch_path(spark, "lines"), F.col("c_custkey")
    line = F.when(c % 13 == 0, F.concat(F.lit("S1-"), c)).otherwise(F.concat(F.lit("S1-"), c, F.lit("\tS2-"), c, F.lit(",S3-"), c))
    rows = proj.table(spark, d, "customer").select(c.alias("at"), line.alias("value"))
    head = spark.createDataFrame([(i - len(first), x) for i, x in enumerate(first)], "at long, value string")
    rows.unionByName(head).coalesce(1).sortWithinPartitions("at").select("value").write.text(folder)
    return folder


@query
def val_header(spark, d):
    """The header rule on four files, the last of which is right."""
    heads = ("source1_entity_id,matched_entity_ids", "a\tb", "", "Source1_Entity_ID\t matched_entity_ids")
    found = None
    for i, head in enumerate(heads):
        rule = validate.header_errors(validate.read_lines(spark, line_file(spark, d, head)), validate.HEADERS["matches"]).select(F.lit(i).alias("file"), "rule", "example")
        found = rule if found is None else found.unionByName(rule)
    return found


@query
def val_malformed(spark, d):
    lines = validate.read_lines(spark, line_file(spark, d, "source1_entity_id\tmatched_entity_ids"))
    return validate.malformed(validate.parsed(lines))


@query
def parsed_lists(spark, d):
    lines = validate.read_lines(spark, line_file(spark, d, "source1_entity_id\tmatched_entity_ids"))
    return validate.parsed(lines).where("ids IS NOT NULL").select("line", "s1_id", joined("ids", "+").alias("ids"))


@query
def val_dup_rows(spark, d):
    return validate.duplicate_rows(broken_lists(spark, d))


@query
def val_dup_ids(spark, d):
    return validate.duplicate_ids(broken_lists(spark, d))


@query
def val_prefix(spark, d):
    rows = broken_lists(spark, d)
    return validate.self_matches(rows).select(F.lit("self").alias("rule"), "offender").unionByName(validate.wrong_prefix(rows).select(F.lit("prefix").alias("rule"), "offender"))


@query
def val_unknown(spark, d):
    return validate.unknown_ids(broken_lists(spark, d), target_ids(spark, d))


@query
def val_missing(spark, d):
    return validate.missing_records(broken_lists(spark, d), s1_ids(spark, d))


@query
def val_extra(spark, d):
    return validate.extra_records(broken_lists(spark, d), s1_ids(spark, d))


@query
def matches_subset(spark, d):
    listed = validate.lists_of(candidate_lists(spark, d), "candidate_entity_ids")
    return validate.outside_candidates(broken_lists(spark, d), listed)


@query
def val_report(spark, d):
    return validate.report(broken_lists(spark, d), s1_ids(spark, d), target_ids(spark, d))


@query
def val_verdict(spark, d):
    return validate.verdict(val_report(spark, d))


