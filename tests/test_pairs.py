"""Candidates in lists: pairs are counted in memory and never shuffled."""

import pytest
from pyspark.sql import functions as F

from linkloom.config import LinkConfig
from linkloom.operators import blocking, metrics
from linkloom.plans import link, queries

SMALL = "/root/testdata/sf0.001"


def shuffles_pairs(df):
    """Whether anything is exchanged after the pairs are made (plans are printed from the result down)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    made = plan.find("MapInArrow")
    return made < 0 or "Exchange" in plan[:made]


@pytest.mark.parametrize("name", ["key_score", "candidate_lists", "label_pairs"])
def test_pairs_stay_where_they_are_made(spark, name):
    assert not shuffles_pairs(queries.QUERIES[name](spark, SMALL))


def test_ranked_pairs_equal_joined_ones(spark):
    """All pairs and the best ones against the plain join, with ties at the cut and records without keys."""
    rows = [(1, f"S1-{i}", f"w{i % 3} x{i % 2} y", "", "") for i in range(6)] + [(1, "S1-none", "", "", "")]
    rows += [(2, f"S2-{i}", f"w{i % 3} x{i % 4} y z{i}", "", "") for i in range(40)]
    p = link.prepare(spark.createDataFrame(rows, "src int, entity_id string, business_name string, business_address string, country string"), LinkConfig())
    joined = blocking.posting_join(blocking.rarest_keys(p.keys, blocking.key_df(p.keys), LinkConfig()), p.keys)
    want = sorted(map(tuple, blocking.scored_pairs(joined, p.n_targets, LinkConfig()).collect()))
    assert sorted(map(tuple, blocking.all_pairs(p.keys, LinkConfig(), p.n_targets).collect())) == want
    best = {}
    for s, t, score, n in sorted(want, key=lambda r: (r[0], -r[2], -r[3], r[1])):
        best.setdefault(s, []).append((t, score, n))
    got = {r.s1_id: list(zip(r.t_ids, r.scores, r.counts)) for r in link.candidate_lists(p, LinkConfig(top_m=7)).collect()}
    assert got == {f"S1-{i}": best[f"S1-{i}"][:7] for i in range(6)} | {"S1-none": []}


def test_postings_go_to_python_with_empty_lists(spark, monkeypatch):
    """Null lists make Spark go over those at a batch's end again for each row that it sends; postings have none, and all of them are sent. Pairs are unfolded by place, not from zipped objects."""
    sent, send = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *a: sent.append(df) or send(df, *a))
    plan = queries.QUERIES["key_score"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    postings = sent[0].where("s1_id IS NULL")
    assert len(sent) == 1 and postings.count() and not postings.where("probes IS NULL OR carried IS NULL OR t_id IS NULL").count()
    assert "arrays_zip" not in plan, plan[:3000]


def test_pairs_by_place_are_all_pairs(monkeypatch):
    """Pairs that share their ids' lists are those of each record alone, bit for bit: cut inside records, over two parts, with records without pairs and shared bounds."""
    import numpy as np
    import pyarrow as pa

    from linkloom.functions import ranking

    monkeypatch.setattr(ranking, "PAIR_ROWS", 7)
    rng = np.random.default_rng(5)
    probes = pa.list_(pa.struct([("key_id", pa.int64()), ("df", pa.int64())]))
    schema = pa.schema([("part", pa.int32()), ("key_id", pa.int64()), ("t_id", pa.string()), ("s1_id", pa.string()), ("probes", probes), ("carried", pa.list_(pa.string()))])
    rows, want = [], {least: [] for least in (1, 2)}
    for part in (4, 2):
        lists = [np.sort(rng.choice(30, n, replace=False)) for n in (1, 2, 3, 9, 20)]
        index = ranking.Postings([np.full(len(x), k) for k, x in enumerate(lists)], [pa.array([f"S2-{t}" for t in x], pa.string()) for x in lists])
        rows += [(part, k, f"S2-{t}", None, [], []) for k, x in enumerate(lists) for t in x]
        for i in range(20):
            own = np.sort(rng.choice(5, rng.integers(0, 5), replace=False))
            df = np.array([len(lists[k]) for k in own], np.int64)
            rows.append((part, None, None, f"S1-{part}-{i}", [{"key_id": int(k), "df": int(n)} for k, n in zip(own, df)], None))
            for least, all_of in want.items():
                at, score, count = index.pairs(own, df, 60, None, None, least)
                all_of += zip([f"S1-{part}-{i}"] * len(at), index.ids.take(pa.array(at)).to_pylist(), score.tolist(), count.tolist())
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 50]], schema) for i in range(0, len(rows), 50)]
    for least, counted in ((1, False), (1, True), (2, False), (2, True)):
        got = []
        for row in (r for b in ranking.paired(iter(batches), 60, least, counted) for r in b.to_pylist()):
            assert len(set(row["t_ids"])) == len(row["t_ids"]) and len(row["places"]) < 14
            made = [row["scores"], row["counts"]] if counted else [row["scores"]]
            got += [(row["s1_ids"][p >> 32], row["t_ids"][p & 0xFFFFFFFF], *x) for p, *x in zip(row["places"], *made)]
        assert sorted(got) == sorted(x[: 3 + counted] for x in want[least]) and got


def test_key_score_asks_for_no_counts(spark):
    """Shared keys are neither counted nor sent where only scores are asked for."""
    counts = lambda name: "counts#" in queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert counts("shared_count") and not counts("key_score")


def test_recall_of_lists(spark):
    """True pairs that are no candidates, and those of records without keys, count as missed."""
    rows = [(1, "S1-1", "alpha beta", "", ""), (1, "S1-2", "", "", ""), (2, "S2-1", "alpha gamma", "", ""), (2, "S2-2", "delta", "", "")]
    p = link.prepare(spark.createDataFrame(rows, "src int, entity_id string, business_name string, business_address string, country string"), LinkConfig())
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-2")], "s1_id string, t_id string")
    got = metrics.list_recall(link.candidate_lists(p, LinkConfig(), truth), truth, link.source_ids(p.records)).first()
    assert tuple(got) == (3, 1, 0.333333, 0.5) and link.candidate_lists(p, LinkConfig()).agg(F.count("*")).first()[0] == 2


def test_features_do_not_shuffle_pairs(spark):
    """From the unfolded lists to the features nothing is exchanged, without broadcasts either."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["f_jaccard"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unfolded = plan.find("Generate")
    assert unfolded > 0 and "Exchange" not in plan[:unfolded], plan[:3000]


@pytest.mark.parametrize("name", ["f_bigram", "f_country", "f05_entity"])
def test_lists_are_read_as_they_lie(spark, name):
    """Written lists are not exchanged on their way to the records of their part, without broadcasts either."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unfolded = plan.find("Generate explode(arrays_zip")
    below = plan[unfolded : plan.find("FileScan", unfolded)]
    assert unfolded > 0 and "Exchange" not in below, plan[:3000]


@pytest.mark.parametrize("parts", [1, 3, 4, 9])
def test_parts_are_dealt_out_evenly(spark, parts):
    """Four shuffle partitions get as many parts each, but for one."""
    names = blocking.part_names(spark, parts)
    rows = spark.createDataFrame([(x,) for x in names], "part int").repartition(4, "part").groupBy(F.spark_partition_id()).count().collect()
    assert len(set(names)) == parts and len(rows) == min(parts, 4) and max(r[1] for r in rows) == -(-parts // 4)


def test_no_table_is_left_in_the_catalog(spark):
    queries.QUERIES["f_country"](spark, SMALL).count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("linkloom")]


def test_shared_keys_rank_like_single_ones(monkeypatch):
    """Records that share their frequent keys get, bit for bit, what each gets alone; with ties, shared bounds and a cap."""
    import numpy as np
    import pyarrow as pa

    from linkloom.functions import ranking

    monkeypatch.setattr(ranking, "SHARED", 8)
    rng = np.random.default_rng(7)
    df = np.array([0, 1, 2, 3, 5, 8, 9, 20, 30, 60, 60, 90])
    lists = [rng.choice(100, n, replace=False) for n in df]
    ids = [pa.array([f"S2-{t}" for t in x], pa.string()) for x in lists]
    index = ranking.Postings([np.full(len(x), k) for k, x in enumerate(lists)], ids)
    for _ in range(300):
        keys = np.sort(rng.choice(12, rng.integers(0, 7), replace=False))
        for m, cap, least in ((7, None, 1), (150, 100, 1), (7, 50, 1), (10, None, 2), (None, None, 1)):
            want, got = (f(keys, df[keys], 100, m, cap, least) for f in (index.pairs, index.top))
            order = [slice(None)] * 2 if m is not None else [np.argsort(x[0]) for x in (want, got)]
            assert all(np.array_equal(x[order[0]], y[order[1]]) for x, y in zip(want, got))


@pytest.mark.parametrize("name", ["f_country", "f_jaro_winkler", "f_key_ratio", "f_postal", "f_empty", "f_digits", "f_core_jaccard", "f_len_ratio", "f_jaccard", "f_fuzz_ratios", "f_overlap", "f_bigram", "f05_macro"])
def test_parts_beyond_the_shuffle_partitions(spark, monkeypatch, name):
    """Each part has a partition of its own, however many there are; lists are still read as they lie."""
    monkeypatch.setattr(blocking, "PART_RECORDS", 10)
    lists = link.candidate_lists(queries.prepared(spark, SMALL), LinkConfig())
    parts = [r[0] for r in lists.groupBy(F.spark_partition_id().alias("at")).agg(F.countDistinct("part").alias("n")).select("n").collect()]
    assert len(parts) > 4 and max(parts) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    unfolded = plan.find("Generate explode(arrays_zip")
    assert unfolded > 0 and "Exchange" not in plan[unfolded : plan.find("FileScan", unfolded)]


def test_only_asked_scores_are_computed(monkeypatch):
    """The kernels of other scores are not run, and pairs that a worker had before are not scored again."""
    from linkloom.functions import lanes, similarity

    a, b = ["alpha beta", "x", "alpha beta"], ["alpha bet", "", "alpha bet"]
    want = {k: [f(x, y) for x, y in zip(a, b)] for k, f in similarity.KERNELS.items()}
    monkeypatch.setattr(lanes, "ratios", lambda *_: pytest.fail("ratios were computed"))
    assert similarity.all_scores(a, b, ("jw",))["jw"].tolist() == pytest.approx(want["jw"])
    monkeypatch.setattr(similarity, "_known", {})
    first = similarity.remembered(a, b, ("jw", "token_set"))
    monkeypatch.setattr(similarity, "all_scores", lambda *_: pytest.fail("scored again"))
    again = similarity.remembered(a, b, ("jw", "token_set"))
    assert all(first[k].tolist() == again[k].tolist() == pytest.approx(want[k]) for k in ("jw", "token_set"))


def test_told_hits_are_counted_without_a_shuffle_of_pairs(spark):
    """Counts by told hits equal those by joined truth, with repeated truth, records without truth, without pairs and unknown ones; f05_macro uses them."""
    truth = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("x", "1")], "s1_id string, t_id string")
    found = spark.createDataFrame([("a", "1", 1), ("a", "3", 0), ("c", "1", 0), ("c", "2", 0)], "s1_id string, t_id string, hit int")
    s1 = spark.createDataFrame([(x,) for x in "abcd"], "s1_id string")
    want, got = (sorted(map(tuple, metrics.record_counts(s1, truth, f).collect())) for f in (found.drop("hit"), found))
    assert got == want == [("a", 2, 2, 1), ("b", 1, 0, 0), ("c", 0, 2, 0), ("d", 0, 0, 0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES["f05_macro"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.find("Generate explode(arrays_zip")]
    assert "hit" in above and not [x for x in above.splitlines() if "Exchange hashpartitioning(s1_id" in x and "t_id" in x.split("plan_id")[0]], above[:3000]


#: Queries whose lists are written before their features are made.
LISTED = ["best_threshold", "f05_entity", "f_core_jaccard", "f_empty", "f_suffix", "f_country", "f_key_ratio", "f_postal", "f_state", "f_overlap", "f_digits", "f_jaccard", "f_len_ratio", "f_bigram", "f_jaro_winkler", "f05_macro", "f_fuzz_ratios", "infer_lists", "error_buckets"]


@pytest.mark.parametrize("name", LISTED)
def test_lists_are_made_without_rows_sent_through_the_driver(spark, monkeypatch, name):
    """No join up to the written lists builds a table in the driver's memory, however small Spark takes its files for."""

    class Written(Exception):
        pass

    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()

    def written(df, *_):
        plans.append(plan(df))
        raise Written

    write = blocking.materialise
    monkeypatch.setattr(blocking, "materialise", lambda df, *a: plans.append(plan(df)) or write(df, *a))
    for module in (queries, link):
        monkeypatch.setattr(module, "dealt", written)
    with pytest.raises(Written):
        queries.QUERIES[name](spark, SMALL)
    assert len(plans) == 3 and "MapInArrow" in plans[-1]
    own = [p[: p.find("WriteFiles")] if "WriteFiles" in p else p for p in plans]
    assert not [p for p in own if "SortMergeJoin" not in p and "Join" in p], own
    assert "Broadcast" not in own[-1], own[-1][:3000]


def test_features_records_are_not_sent_through_the_driver(spark):
    """Which records a part needs is joined by sorting, in small tables too."""
    plan = queries.QUERIES["f_empty"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan[:3000]


def test_infer_lists_writes_only_pairs_that_train(spark, monkeypatch):
    """infer_lists features all pairs where they are scored: none is shuffled, sent through the driver or written but those that train. Its lists are those of written pairs."""
    from linkloom.operators import labels, model, output
    from linkloom.sources import projections

    cfg = LinkConfig(top_m=5, train_share=50, val_share=30, rounds=10)
    monkeypatch.setattr(queries, "CFG", cfg)
    made, written, train = {}, [], link.train_lists
    monkeypatch.setattr(link, "train_lists", lambda lists, *a: made.update(lists=lists, p=a[0], model=train(lists, *a)) or made["model"])
    for module in (queries, link):
        monkeypatch.setattr(module, "materialise", lambda df, *a, f=module.materialise: written.append(f(df, *a)) or written[-1])
    found = queries.QUERIES["infer_lists"](spark, SMALL)
    assert written and not [w for w in written if w.where(labels.split_of(F.col("s1_id"), cfg) == "rest").count()]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan[:3000]
    above = plan[: plan.find("Generate explode(arrays_zip")]
    assert not [x for x in above.splitlines() if "Exchange" in x and "t_id" in x.split("plan_id")[0].replace("collect_set(t_id", "")], above[:3000]
    rows, truth = link.featured(made["p"], cfg).cache(), projections.company_truth(spark, SMALL)
    fitted, threshold = made["model"]
    listed, matched = link.infer(projections.company_records(spark, SMALL), fitted, threshold, cfg, pairs=rows)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, listed.join(matched, "source1_entity_id").collect()))
    told = {(r.s1_id, r.t_id): r.label for r in written[0].collect()}
    wanted = labels.label_pairs(rows, truth, cfg).where("split <> 'rest'").collect()
    assert told == {(r.s1_id, r.t_id): r.label for r in wanted} and 0 < sum(told.values()) < len(told)
    assert metrics.macro_f05(metrics.record_counts(link.source_ids(made["p"].records), truth, output.matches(model.predict(fitted, rows), threshold))).first().macro_f05 > 0.9
    rows.unpersist()
