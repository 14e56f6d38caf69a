"""Keys, candidates, metrics, lists, checks, sources, streaming and the whole plan."""

import os

import pytest
from pyspark.sql import functions as F

from linkloom.config import LinkConfig
from linkloom.operators import blocking, keys, labels, metrics, model, output, validate
from linkloom.plans import link, queries
from linkloom.sources import projections, tables
from linkloom.streaming import arrivals

SMALL = "/root/testdata/sf0.001"
CFG = LinkConfig(top_m=5)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "s2, s3, want",
    [
        ([[3, 7], [3]], [[1], [3]], {1: {2}, 3: {0, 1, 3}, 7: {0}}),
        ([[9], [1]], [[1], [9]], {1: {1, 2}, 9: {0, 3}}),
        ([[5, 5, 6], [6]], [[6]], {5: {0}, 6: {0, 1, 2}}),
    ],
)
def test_inverted_index(spark, s2, s3, want):
    """Which targets each key leads to; a key counts once per record, so df is its number of postings."""
    rows = [(2 if i < len(s2) else 3, str(i), str(k), "n") for i, ks in enumerate(s2 + s3) for k in sorted(set(ks))]
    probes = [(1, f"p{k}", str(k), "n") for k in want]
    all_keys = table(spark, rows + probes, "src int, entity_id string, key string, key_class string")
    frequency = blocking.key_df(all_keys)
    chosen = blocking.rarest_keys(all_keys, frequency, CFG)
    got = {}
    for r in blocking.posting_join(chosen, all_keys).collect():
        got.setdefault(int(r.key), set()).add(int(r.t_id))
    assert got == want and {int(r.key): r.df for r in frequency.collect()} == {k: len(v) for k, v in want.items()}


def test_record_keys(spark):
    rows = table(spark, [(1, "S1-1", "Acme Ltd", "Flat 12b, 400001", "India"), (1, "S1-2", "", "", "")], "src int, entity_id string, business_name string, business_address string, country string")
    got = {(r.entity_id, r.key, r.key_class) for r in keys.blocking_keys(keys.prepare(tables.normalise(rows))).collect()}
    want = ["nacme", "nltd", "Bacme+ltd", "aflat", "a12b", "a400001", "C12b+flat", "C12b+400001", "D12|400001", "z400001"]
    assert got == {("S1-1", "india|" + k, k[0]) for k in want}


def test_f05(spark):
    counts = table(spark, [("a", 2, 3, 2), ("b", 0, 0, 0), ("c", 0, 1, 0), ("d", 2, 0, 0), ("e", 1, 1, 1)], "s1_id string, n_true long, n_found long, n_hit long")
    got = {r.s1_id: r.f05 for r in metrics.record_f05(counts).collect()}
    assert got == {"a": pytest.approx(0.714, abs=1e-3), "b": 1.0, "c": 0.0, "d": 0.0, "e": 1.0}
    assert tuple(metrics.macro_f05(counts).select("perfect", "missed", "fp_only").first()) == (2, 1, 1)


def test_lists_and_files(spark, tmp_path):
    s1 = table(spark, [("S1-00001",), ("S1-00002",), ("S1-00003",)], "s1_id string")
    pairs = table(spark, [("S1-00001", "S3-1"), ("S1-00001", "S2-9"), ("S1-00001", "S2-1"), ("S1-00002", "S2-7")], "s1_id string, t_id string")
    lists = output.id_lists(s1, pairs, "matched_entity_ids")
    assert sorted(map(tuple, lists.collect())) == [("S1-00001", "S2-1,S2-9,S3-1"), ("S1-00002", "S2-7"), ("S1-00003", "")]
    output.write_lists(lists.coalesce(1), f"{tmp_path}/out")
    assert sorted(map(tuple, tables.read_truth(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, pairs.collect()))
    part = next(f"{tmp_path}/out/{f}" for f in os.listdir(f"{tmp_path}/out") if f.endswith(".csv"))
    assert validate.check_file(spark, part, "matches", s1).count() == 0


RULES = [
    ("", {"empty file"}), ("source1_entity_id,matched_entity_ids\n", {"comma separated"}), ("a\tb\n", {"wrong header"}),
    ("Source1_Entity_ID\t matched_entity_ids\nS1-1\tS2-1\nS1-2\t\n", set()),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nbad\nS1-2\t\n", {"malformed row"}),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-1\t\nS1-2\t\n", {"duplicate record"}),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-2\t\n", {"duplicate id in a list"}),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS1-2,X-1\nS1-2\t\n", {"self match", "wrong prefix"}),
    ("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-5\nS1-9\t\n", {"unknown id", "missing record", "extra record"}),
]


@pytest.mark.parametrize("content, want", RULES)
def test_checks(spark, tmp_path, content, want):
    path = tmp_path / "lists.tsv"
    path.write_text(content)
    required, valid = table(spark, [("S1-1",), ("S1-2",)], "s1_id string"), table(spark, [("S2-1",)], "t_id string")
    assert {r.rule for r in validate.check_file(spark, str(path), "matches", required, valid).collect()} == want


def test_missing_file_and_subset(spark, tmp_path):
    required = table(spark, [("S1-1",)], "s1_id string")
    assert validate.check_file(spark, f"{tmp_path}/none", "matches", required).first().rule == "file not found"
    matched, listed = (validate.lists_of(table(spark, [("S1-1", x)], "source1_entity_id string, ids string"), "ids") for x in ("S2-1,S2-2", "S2-1"))
    found = validate.report(matched, required, candidates=listed)
    assert [(r.rule, r.severity) for r in found.collect()] == [("match outside candidates", "warning")]
    assert validate.verdict(found).first().verdict == "PASS"


def test_source_tables(spark, tmp_path):
    (tmp_path / "train_source2.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"Quoted\\ NA\tNA\t\nS2-2\t\tCafé 1\tFrance\n', encoding="utf-8")
    rows = tables.read_source(spark, f"{tmp_path}/train_source2.tsv")
    assert sorted(map(tuple, rows.collect())) == [(2, "S2-1", '"Quoted\\ NA', "NA", ""), (2, "S2-2", "", "Café 1", "France")]
    assert tables.write_normalised(rows, f"{tmp_path}/norm") == 2 and tables.write_normalised(rows.limit(0), f"{tmp_path}/norm") == 2
    assert {r.addr_norm for r in tables.read_normalised(spark, f"{tmp_path}/norm", "addr_norm").collect()} == {"na", "cafe 1"}
    assert tables.read_ids(spark, f"{tmp_path}/train_source2.tsv").count() == 2
    tables.write_metrics(spark.createDataFrame([(1, 0.5)], "n int, recall double"), f"{tmp_path}/m")
    assert tables.read_metrics(spark, f"{tmp_path}/m").first().recall == 0.5


def test_candidates_and_split(spark):
    got = queries.company_candidates(spark, SMALL).groupBy("s1_id").count().agg(F.max("count")).first()[0]
    assert got <= queries.CFG.top_m == 150
    recall = queries.QUERIES["candidate_recall"](spark, SMALL).first()
    assert recall.recall > 0.95 and recall.true_pairs == 165
    shares = {r.split: r["count"] for r in queries.QUERIES["split_by_hash"](spark, "/root/testdata/sf0.01").groupBy("split").count().collect()}
    assert 100 < shares["train"] < 200 and 100 < shares["val"] < 200
    marked = labels.label_pairs(queries.company_candidates(spark, SMALL), projections.company_truth(spark, SMALL), CFG)
    assert marked.agg(F.sum("label")).first()[0] == recall.hits


def test_soft_cap_spares_records_of_frequent_keys(spark):
    keys_of = [(1, "a", "rare", "n"), (1, "a", "hot", "n"), (1, "b", "hot", "n"), (2, "t", "rare", "n"), *((2, f"t{i}", "hot", "n") for i in range(9))]
    rows = table(spark, keys_of, "src int, entity_id string, key string, key_class string")
    got = blocking.rarest_keys(rows, blocking.key_df(rows), LinkConfig(soft_cap=5)).collect()
    assert {(r.s1_id, r.key) for r in got} == {("a", "rare"), ("b", "hot")}


@pytest.mark.parametrize("cap, m, shared", [(1, 3, 1), (4, 3, 1), (4, 1, 1), (10, 5, 2), (40, 2, 1)])
def test_frequent_keys_are_spared_without_a_change(spark, cap, m, shared):
    records = projections.company_records(spark, SMALL)
    p = link.prepare(records, LinkConfig(scripts=False))
    rows = lambda **k: sorted(map(tuple, blocking.candidates(p.keys, LinkConfig(top_m=m, min_shared=shared, **k), p.n_targets).collect()))
    assert rows(posting_cap=cap) == rows(posting_cap=None)


def test_keys_are_computed_once(spark):
    """No filter repeats the token pipeline, and the plan holds each phrase but once a column."""
    rows = keys.prepare(tables.normalise(projections.company_records(spark, SMALL), False))
    plan = keys.blocking_keys(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replace(") < 200


def test_train_and_infer(spark, tmp_path):
    records, truth = projections.company_records(spark, SMALL), projections.company_truth(spark, SMALL)
    cfg = LinkConfig(top_m=5, train_share=50, val_share=30, scripts=False, rounds=40)
    stored = link.prepare(records, cfg, f"{tmp_path}/store")
    assert sorted(map(tuple, stored.keys.collect())) == sorted(map(tuple, link.prepare(records, cfg).keys.collect()))
    pairs = link.featured(stored, cfg).cache()
    fitted, threshold = link.train(records, truth, cfg, pairs=pairs)
    model.save(fitted, f"{tmp_path}/model", threshold)
    assert model.load_threshold(f"{tmp_path}/model") == threshold
    found = output.matches(model.predict(model.load(f"{tmp_path}/model"), pairs), threshold)
    f05 = metrics.macro_f05(metrics.record_counts(link.source_ids(records), truth, found)).first().macro_f05
    plain = output.matches(pairs.select("s1_id", "t_id", F.col("n_jaccard").alias("score")), 0.6)
    assert f05 > 0.9 and f05 > metrics.macro_f05(metrics.record_counts(link.source_ids(records), truth, plain)).first().macro_f05
    listed, matched = link.infer(records, fitted, threshold, cfg)
    want = {(r.s1_id, r.t_id) for r in found.collect()}
    assert {(r.source1_entity_id, t) for r in matched.collect() for t in r.matched_entity_ids.split(",") if t} == want
    assert listed.count() == matched.count() == link.source_ids(records).count()
    pairs.unpersist()


def test_stages_from_files_to_lists(spark, tmp_path):
    """All stages from tab-separated files; a second run reuses what is there, and a stopped one goes on."""
    from linkloom.plans.driver import Driver

    records, truth = projections.company_records(spark, SMALL), projections.company_truth(spark, SMALL)
    for split in ("train", "test"):
        (tmp_path / "data" / split).mkdir(parents=True)
        for i in (1, 2, 3):
            records.where(F.col("src") == i).drop("src").toPandas().to_csv(tmp_path / "data" / split / f"{split}_source{i}.tsv", sep="\t", index=False)
    lists = output.id_lists(link.source_ids(records), truth, "matched_entity_ids").toPandas()
    lists.loc[0, "matched_entity_ids"] += ",S2-unknown"
    lists.to_csv(tmp_path / "data" / "train" / "train_ground_truth.tsv", sep="\t", index=False)
    driver = Driver(spark, f"{tmp_path}/data", f"{tmp_path}/work", f"{tmp_path}/out", LinkConfig(top_m=5, train_share=50, val_share=30, rounds=20))
    driver.run()
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    driver.run()
    assert stamps == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    recall = tables.read_metrics(spark, f"{tmp_path}/work/recall").first()
    assert recall.true_pairs == 165 and spark.read.parquet(f"{tmp_path}/work/positives").count() == recall.hits
    assert validate.verdict(driver.check()).first().verdict == "PASS"
    found = tables.read_truth(spark, f"{tmp_path}/out/matching_results")
    assert metrics.macro_f05(metrics.record_counts(link.source_ids(records), truth, found)).first().macro_f05 > 0.85


def test_lines_are_numbered_over_splits(spark, tmp_path):
    path = tmp_path / "long.tsv"
    path.write_text("".join(f"row {i}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = validate.read_lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
        assert all(r.value == f"row {r.line}" for r in rows.collect()) and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_names_five_examples(spark):
    rows = validate.lists_of(table(spark, [(f"S1-{i:03}", "S2-1,S2-1") for i in range(300)], "source1_entity_id string, ids string"), "ids")
    found = validate.report(rows, rows.select("s1_id")).first()
    assert (found.rule, found.n, found.examples) == ("duplicate id in a list", 300, ", ".join(f"S1-{i:03}" for i in range(5)))


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    records = projections.company_records(spark, SMALL)
    cfg = LinkConfig(top_m=5, scripts=False)
    p = link.prepare(records, cfg)
    index = arrivals.probe_index(p.keys, blocking.key_df(p.keys), cfg).cache()
    (tmp_path / "in").mkdir()
    targets = records.where("src > 1").drop("src").toPandas()
    for i in range(2):
        targets.iloc[i::2].to_csv(tmp_path / "in" / f"t{i}.tsv", sep="\t", index=False)
    run = arrivals.link_stream(arrivals.stream_source(spark, f"{tmp_path}/in"), index, p.n_targets, cfg, f"{tmp_path}/out", f"{tmp_path}/ck")
    run.processAllAvailable()
    run.stop()
    want = blocking.scored_pairs(blocking.posting_join(index, p.keys), p.n_targets, cfg)
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.present("no_such_module") is None and entry.present("no_such_package.module") is None


def test_errors_inside_a_module_are_not_hidden(tmp_path, monkeypatch):
    import __spark_entry__ as entry

    (tmp_path / "broken_module.py").write_text("import no_such_module\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry.present("broken_module")
