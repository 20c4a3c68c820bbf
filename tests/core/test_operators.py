import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, scoring
from tessera.operators import audit, evaluate, gates, identity, mining, packed, pairs, runs, sampling, selection, sidecar, split
from tessera.sources import frames as frame_files
from tessera.sources import tables


def frames(spark, rows):
    return spark.createDataFrame(rows, "game string, label int, video_id string, frame_id int")


def scored(spark, rows):
    return spark.createDataFrame([(m, y, 1 / (1 + math.exp(-m))) for m, y in rows], "margin double, label int, p double")


def test_pairs_need_a_real_target_in_their_own_video(spark):
    gap = frames(spark, [("g", 0, "01", i) for i in (1, 2, 4)])
    assert [(r["frame0_id"], r["frame1_id"]) for r in pairs.build_pairs(gap, 2).collect()] == [(2, 4)]
    apart = frames(spark, [("g", 0, "01", 1), ("g", 0, "02", 3), ("g", 1, "01", 3)])
    assert pairs.build_pairs(apart, 2).count() == 0
    dense = frames(spark, [("g", 0, "01", i) for i in (1, 2, 3, 4, 4)])
    assert {r["delta"]: r["n_pairs"] for r in pairs.pair_counts(dense).collect()} == {1: 3, 2: 2, 3: 1}
    with pytest.raises(ValueError):
        pairs.build_pairs(gap, 0)


@pytest.mark.parametrize("n,k", [(50, 7), (10, 10), (10, 20), (101, 2), (5, 1)])
def test_subsample_positions(spark, n, k):
    df = spark.range(n).select(F.col("id").alias("position"))
    got = sorted(r["position"] for r in pairs.subsample(df, k).collect())
    if n <= k:
        assert got == list(range(n))
    elif k > 1:
        assert got[0] == 0 and got[-1] == n - 1 and len(got) == k


def test_threshold_is_strict_and_counts_fit(spark):
    c = scalars.margin_of_threshold(0.99)
    rows = scored(spark, [(c, 1), (c + 1e-6, 1), (-1.0, 0), (10.0, 0)])
    r = evaluate.group_counts(rows, 0.99).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 1)
    assert abs(c - math.log(99)) < 1e-12


def test_ties_give_half(spark):
    rows = spark.createDataFrame([(0.5, 0), (0.5, 1)], "p double, label int")
    s = evaluate.by_score(rows)
    assert evaluate.roc_auc(s).first()[0] == 0.5 and evaluate.average_precision(s).first()[0] == 0.5
    one = evaluate.by_score(rows.where("label = 1"))
    assert evaluate.roc_auc(one).first()[0] == 0.0


def test_rank_metrics_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 2), rng.randint(0, 1)) for _ in range(300)]
    s = evaluate.by_score(spark.createDataFrame(rows, "p double, label int"))
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(evaluate.roc_auc(s).first()[0] - auc) < 1e-12
    ap, tp, seen = 0.0, 0, 0
    for score in sorted({p for p, _ in rows}, reverse=True):
        ys = [y for p, y in rows if p == score]
        tp, seen = tp + sum(ys), seen + len(ys)
        ap += sum(ys) * tp / seen
    assert abs(evaluate.average_precision(s).first()[0] - ap / len(pos)) < 1e-12


def test_empty_conventions(spark):
    empty = scored(spark, [(0.0, 0)]).limit(0)
    hist = evaluate.histogram(empty, 10)
    assert evaluate.low_fpr(hist, 10, 0.1).first()["partial_auc"] == 0.0
    assert [r["value"] for r in evaluate.percentiles(hist, 10, [0.5]).collect()] == [None]
    assert evaluate.ece(evaluate.calibration_bins(empty)).first()[0] == 0.0
    counts = spark.createDataFrame([], "tp long, fp long, fn long, tn long")
    assert tuple(evaluate.worst_groups(counts).first()) == (0.0, 0.0)
    assert tuple(evaluate.worst_groups(counts, subtype=True).first()) == (None, None)
    assert evaluate.loss_summary(empty, 0.9, 0.0, 1.0).first()["positive_margin_pass_rate"] is None


def test_worst_groups_golden(spark):
    counts = spark.createDataFrame([(10, 2, 1, 88), (5, 0, 0, 50)], "tp long, fp long, fn long, tn long")
    r = evaluate.worst_groups(counts, subtype=True).first()
    assert abs(r["worst_fpr"] - 2 / 90) < 1e-12 and abs(r["worst_recall"] - 10 / 11) < 1e-12


def test_tail_loss_and_ranking(spark):
    rows = scored(spark, [(-2.0, 0), (1.0, 0), (3.0, 0), (0.0, 1), (5.0, 1)])
    assert evaluate.tail_loss(rows, F.col("margin"), 2).first()[0] == 2.0
    assert abs(evaluate.tail_loss(rows, F.col("margin"), None).first()[0] - 2 / 3) < 1e-12
    got = evaluate.ranking_penalty(rows, 0.5, 1.0).first()[0]
    assert abs(got - (max(0, 1 - 0 + 3) + max(0, 1 - 5 + 3)) / 2) < 1e-12


def sources(rng):
    out = {}
    for g in range(rng.randint(1, 3)):
        for v in range(3):
            strata = {(f"g{g}", y): max(0, rng.randint(1, 12) - 2) for y in (0, 1) if rng.random() < 0.6}
            if strata:
                out[f"g{g}::{v}"] = strata
    return out


def test_every_stratum_gets_both_sides():
    for seed in range(150):
        rng = random.Random(seed)
        src = sources(rng)
        sides = split.assign(src, 0.3, seed, small="warn")
        assert sides == split.assign(dict(reversed(list(src.items()))), 0.3, seed, small="warn")
        members = defaultdict(set)
        for uid, strata in src.items():
            for s in strata:
                members[s].add(uid)
        bound = {u for us in members.values() if len(us) < 2 for u in us}
        for us in members.values():
            free = us - bound
            if len(free) >= 2:
                assert {sides[u] for u in free} == {"train", "val"}


def test_extension_keeps_what_was_split():
    rng = random.Random(5)
    src = {f"g::{i}": {("g", 0): rng.randint(1, 9)} for i in range(30)}
    old = split.assign({u: s for u, s in src.items() if int(u[3:]) < 20}, 0.25, 3)
    new = split.assign(src, 0.25, 3, existing=old)
    assert all(new[u] == side for u, side in old.items()) and len(new) == 30
    with pytest.raises(ValueError):
        split.assign({"a": {("g", 0): 5}}, 0.2, 1)


def test_split_over_frames(spark):
    rows = [(f"g{g}", y, f"{v + 4 * y + 8 * g:02d}", i) for g in range(2) for y in (0, 1) for v in range(4) for i in range(12)]
    groups = pairs.source_groups(frames(spark, rows), "game_video")
    a = split.split(groups, 0.25, 11).collect()
    b = split.split(groups, 0.25, 11, scope="game").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 16
    assert Counter(r["split"] for r in a)["val"] >= 4
    assert split.resolve(None, "refuse") == "create"
    row = {"split_seed": 1, "split_val_ratio": 0.2, "dataset_fingerprint": "x"}
    assert split.resolve(row, "refuse", split_seed=1, split_val_ratio=0.2 + 1e-12, dataset_fingerprint="x") == "reuse"
    assert split.resolve(row, "extend", split_seed=1, split_val_ratio=0.2, dataset_fingerprint="y") == "extend"
    with pytest.raises(ValueError):
        split.resolve(row, "extend", split_seed=2, split_val_ratio=0.2, dataset_fingerprint="y")


def test_mining_fixture(spark):
    logit = lambda s: 1 / (1 + math.exp(-2 * s))
    rows = [("A", "01", 1, 3, 0.9), ("A", "01", 2, 4, 0.8), ("A", "02", 1, 3, 0.7), ("A", "02", 2, 4, 0.6), ("B", "01", 1, 3, 0.95), ("B", "01", 1, 3, 0.95)]
    df = spark.createDataFrame([(f"{g}::{v}#x", f"{g}::{v}", g, v, a, b, 2, logit(s), 0) for g, v, a, b, s in rows], "source_version_id string, stable_source_id string, game string, video_id string, frame0_id int, frame1_id int, delta int, p_positive double, label int")
    top = mining.hard_negatives(df, 1).orderBy(F.desc("p_positive")).collect()
    assert [r["stable_source_id"] for r in top] == ["B::01", "A::01", "A::02"] and abs(top[1]["p_positive"] - 0.858) < 1e-3
    assert all(r["p_positive"] >= 0.8 for r in mining.hard_negatives(df, 9, 0.8).collect())
    assert mining.hard_negatives(df, 9, None, 2).count() == 2
    assert mining.hard_negatives(df.withColumn("label", F.lit(1)), 9).count() == 0
    assert mining.mixed_versions(df.withColumn("source_version_id", F.concat("stable_source_id", F.col("frame0_id").cast("string")))).count() == 2


def test_sidecar(spark):
    side = spark.createDataFrame([("A::0::01", "wooden_bridge", 2.0), ("x", "", -1.0)], "stable_source_id string, negative_subtype string, sample_weight double")
    entries = spark.createDataFrame([("A::0::01", None, 1.0), ("B", "flat", 1.0), ("x", "own", 1.0)], "stable_source_id string, negative_subtype string, sample_weight double")
    got = {r["stable_source_id"]: (r["negative_subtype"], r["sample_weight"]) for r in sidecar.enrich(entries, side).collect()}
    assert got == {"A::0::01": ("wooden_bridge", 2.0), "B": ("flat", 1.0), "x": ("own", -1.0)}
    assert [tuple(r) for r in sidecar.invalid(side).collect()] == [("bad_weight", "x")]
    new = spark.createDataFrame([("A::0::01", "", None), ("N", "tag", None)], "stable_source_id string, negative_subtype string, sample_weight double")
    out, conflicts = sidecar.upsert(side, new, "overwrite")
    rows = {r["stable_source_id"]: (r["negative_subtype"], r["sample_weight"], r["status"]) for r in out.collect()}
    assert rows["A::0::01"] == (None, 2.0, "updated") and rows["N"] == ("tag", 1.0, "new") and rows["x"][2] == "unchanged"
    assert [r["incoming"] for r in conflicts.collect()] == ["<cleared>"]
    kept, _ = sidecar.upsert(side, new, "keep")
    assert kept.where("stable_source_id = 'A::0::01'").first()["negative_subtype"] == "wooden_bridge"


def stop(values, patience, min_delta=0.0, burn_in=0):
    best, best_step, bad = None, None, 0
    for step, v in values:
        if v is None:
            continue
        if best is None or v > best + min_delta:
            best, best_step, bad = v, step, 0
        elif step >= burn_in:
            bad += 1
            if bad >= patience:
                return best, best_step, bad, step
    return best, best_step, bad, None


def test_early_stopping_fold(spark):
    rng = random.Random(9)
    rows = {f"r{k}": [(s, rng.choice([None, round(rng.random(), 1), round(rng.random(), 1)])) for s in range(rng.randint(1, 25))] for k in range(25)}
    df = spark.createDataFrame([(g, s, v) for g, r in rows.items() for s, v in r], "run string, step int, score double").repartition(3)
    got = {r["run"]: (r["best_value"], r["best_step"], r["bad_count"], r["stop_step"]) for r in selection.early_stopping(df, ["run"], "score", 3, 0.05, 6).collect()}
    assert got == {g: stop(r, 3, 0.05, 6) for g, r in rows.items()}


def test_selection_order(spark):
    base = dict(global_fpr=0.005, worst_game_fpr=0.01, global_recall=0.9, worst_game_recall=0.8, negative_score_p999=0.1, worst_game_f1=0.7)
    variants = [{}, {"global_fpr": 0.5, "global_recall": 1.0}, {"global_recall": 0.95}, {"worst_game_recall": 0.85}, {"negative_score_p999": 0.05}, {"global_fpr": None}]
    rows = [(i, *[(base | v)[k] for k in base]) for i, v in enumerate(variants)]
    df = spark.createDataFrame(rows, "step int, " + ", ".join(f"{k} double" for k in base))
    s = selection.Selection("constrained", {"max_global_fpr": 0.01, "max_worst_game_fpr": 0.02, "min_positive_recall": 0.8})
    order = [r["step"] for r in selection.ranked(df, s).orderBy("place").collect()]
    assert order == [2, 3, 4, 0, 1, 5]
    assert [r["step"] for r in selection.top_k(df, s, 2).collect()] == [2, 3]


def test_gates_and_settings(spark):
    metrics = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, value double")
    specs = spark.createDataFrame([("a", "<=", 0.5), ("a", "<", 0.5), ("b", ">", 0.0), ("c", ">=", 0.0)], "name string, op string, bound double")
    assert sorted((r["name"], r["op"], r["passed"]) for r in gates.check(metrics, specs).collect()) == [("a", "<", False), ("a", "<=", True), ("b", ">", False), ("c", ">=", False)]
    problems = gates.validate({"recal": {"op": ">", "value": 1}, "recall": 0.5, "f1": {"op": "~", "value": 1}, "fpr": {"op": "<", "value": True}}, ["recall", "f1", "fpr"])
    assert len(problems) == 4 and "recall" in problems[0]
    assert gates.override({"a": {"b": 1}}, ["a.b=2"]) == {"a": {"b": 2}}
    with pytest.raises(KeyError):
        gates.override({"a": {"b": 1}}, ["a.c=2"])
    assert gates.flatten(gates.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}})) == {"a.b": 3, "a.c": 2}
    d = gates.difference(*[spark.createDataFrame(r, "key string, value string") for r in ([("a", "1")], [("a", "2")])])
    assert gates.resume_kind(d, ["a"]).first()[0] == "extend" and gates.resume_kind(d, []).first()[0] == "fork" and gates.resume_kind(d.limit(0), []).first()[0] == "exact"


def entries(spark):
    starts = list(range(20))
    rows = [(g, y, f"{v:02d}", 1.0, None, starts, starts, starts) for g, n in (("small", 1), ("large", 4)) for y in (0, 1) for v in range(n)]
    return spark.createDataFrame(rows, "game string, label int, video_id string, sample_weight double, bucket string, starts_1 array<int>, starts_2 array<int>, starts_3 array<int>")


def test_sampling_shares_and_resume(spark):
    args = (7, 0, {1: 0.2, 2: 0.7, 3: 0.1}, {0: 0.5, 1: 0.5}, 0.5)
    all_ = sampling.draw(entries(spark), sampling.slots(spark, 40, 128), *args).cache()
    n = all_.count()
    assert n == 40 * 128
    share = lambda cond: all_.where(cond).count() / n
    assert abs(share("delta = 2") - 0.7) < 0.03 and abs(share("label = 1") - 0.5) < 0.03 and abs(share("game = 'large'") - 2 / 3) < 0.03
    later = sampling.draw(entries(spark), sampling.slots(spark, 40, 128, 35), *args)
    assert sorted(map(tuple, later.collect())) == sorted(map(tuple, all_.where("step >= 35").collect()))
    attempts = None
    for k in range(4):
        part = sampling.draw(entries(spark), sampling.slots(spark, 3, 32), *args, attempt=k).withColumn("attempt", F.lit(k))
        attempts = part if attempts is None else attempts.unionByName(part)
    got = sampling.deduplicated(attempts, "pair").collect()
    taken = Counter((r["step"], r["game"], r["label"], r["video_id"], r["delta"], r["start"]) for r in got if not r["duplicate"])
    assert len(got) == 96 and max(taken.values()) == 1
    with pytest.raises(ValueError):
        sampling.pick(F.lit(0.5), {1: 0.0})
    with pytest.raises(ValueError):
        sampling.require_weights(entries(spark).withColumn("sample_weight", F.lit(0.0)))


def test_weights_decide_between_videos(spark):
    rows = [("g", 0, "a", 1.0, None, [0]), ("g", 0, "b", 9.0, None, [0])]
    e = spark.createDataFrame(rows, "game string, label int, video_id string, sample_weight double, bucket string, starts_1 array<int>")
    got = sampling.draw(e, sampling.slots(spark, 20, 50), 1, 0, {1: 1.0}, {0: 1.0}, 1.0)
    assert got.where("video_id = 'b'").count() / got.count() > 0.85


def png(path, width=16, height=8, colour=2, extra=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBB", width, height, 8, colour) + extra)


def test_scan(spark, tmp_path):
    root = tmp_path / "data"
    png(root / "g1/0/0100001.png", extra=b"a")
    png(root / "g1/1/0200002.PNG".replace("PNG", "png"))
    png(root / "g1/1/bad.png")
    png(root / "g1/1/0300003.png", width=9)
    png(root / "g1/x/0100001.png")
    png(root / "g1/0/deep/0100001.png")
    png(root / "g1/_old/0100001.png")
    png(root / "g1/Cache/0100001.png")
    (root / "g1/0/notes.txt").write_text("x")
    (root / "g1/0/0400004.png").write_bytes(b"short")
    found, findings = frame_files.scan(spark, str(root), "train", (16, 8, 3))
    rows = {r["sample_id"]: r for r in found.collect()}
    assert set(rows) == {"train:g1:0:01:00001", "train:g1:1:02:00002"}
    one = rows["train:g1:0:01:00001"]
    assert one["content_sha256"] == hashlib.sha256((root / "g1/0/0100001.png").read_bytes()).hexdigest() and one["channels"] == 3
    assert Counter(r["kind"] for r in findings.collect()) == Counter(["invalid_filename", "unexpected_dimensions", "invalid_label_directory", "unexpected_nested_directory", "ignored_directory", "non_frame_extension", "invalid_file"])
    indexed = spark.createDataFrame(found.collect(), found.schema)
    png(root / "g1/0/0100001.png", extra=b"b")
    (root / "g1/1/0200002.png").unlink()
    assert sorted(r["problem"] for r in frame_files.changed_files(spark, indexed, str(root)).collect()) == ["changed", "missing_file"]


def test_bundle_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    b = tables.Bundle(spark, str(tmp_path / "bundle"))
    with pytest.raises(FileNotFoundError):
        b.manifest()
    b.publish({"t": df}, seed=3)
    assert b.manifest()["seed"] == 3 and b.read("t").collect() == df.collect() and b.problems() == []
    with pytest.raises(FileExistsError):
        b.publish({"t": df})
    df.write.parquet(str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "plain"))
    log = tmp_path / "log.jsonl"
    log.write_text('{"step": 1, "loss": 0.5}\n\nbroken\n{"step": 2, "loss": "x"}\n{"step": 3, "loss": 0.25}\n')
    got = tables.read_log(spark, str(log), "step long, loss double").collect()
    assert [(r["step"], r["loss"]) for r in got if r["loss"] is not None] == [(1, 0.5), (3, 0.25)]
    assert tables.canonical_sha256({"b": 1, "a": 2}) == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()


def test_audit_severities(spark):
    rows = [("train", "g", 0, "01", 1, "/a/1.png", "h1", "g::01"), ("test", "g", 0, "02", 1, "/b/1.png", "h1", "g::02"), ("train", "g", 1, "03", 1, "/a/2.png", "h2", "g::03"), ("train", "g", 0, "04", 1, "/a/3.png", "h2", "g::04"), ("val", "g", 0, "01", 9, "/c/9.png", "h3", "g::01")]
    df = spark.createDataFrame(rows, "split string, game string, label int, video_id string, frame_id int, path string, content_sha256 string, stable_source_id string")
    kinds = {r["content_sha256"]: (r["kind"], r["severity"]) for r in audit.content_duplicates(df).collect()}
    assert kinds["h1"] == ("same_label_content_overlap_across_splits", "warning") and kinds["h2"][1] == "error"
    assert tuple(audit.repeated_names(df).first()) == (1, 2)
    found = Counter(r["rule"] for r in audit.violations(df, spark.createDataFrame([], "split string, game string, label int, delta int, n_pairs long"), audit.content_duplicates(df)).collect())
    assert found["duplicate_content"] == 2 and found["source_in_two_splits"] == 1 and found["no_legal_pairs"] == 2
    with pytest.raises(RuntimeError):
        audit.require_clean(spark.createDataFrame([("r", "s", "d")], "rule string, subject string, detail string"))
    assert not identity.covers_content(df.withColumn("content_sha256", F.lit(""))).first()[0]


def test_packed_places(spark):
    lay = packed.layout(frames(spark, [("g", 0, f"{v:02d}", i) for v in range(5) for i in range(7)]), 8, 10)
    assert packed.contiguity(lay).first()["contiguous"]
    assert not packed.contiguity(lay.where("frame_index <> 3")).first()["contiguous"]
    assert packed.fetch(lay, spark.createDataFrame([(9,)], "frame_index long"), 8).first()["offset"] == 10


@pytest.mark.parametrize("indexes", [[], [0], [1], [0, 2, 2, 3, 3, 4, 7, 7, 8], [0, 1, 2, None], [-1, 0, 1], [2, 0, 1], list(range(70_000)), [*range(32_768), 32_767], [0, 0]])
def test_contiguity_is_told_from_each_index(spark, indexes):
    """Also of repeats and gaps that leave sums and sums of squares as they were."""
    df = spark.createDataFrame([(i,) for i in indexes], "frame_index long").repartition(3)
    assert packed.contiguity(df).first() == (len(indexes), None not in indexes and sorted(indexes) == list(range(len(indexes))))


def test_logs_keep_the_order_of_appending(spark, tmp_path):
    path = str(tmp_path / "runs")
    tables.append_log(spark.createDataFrame([("r", "started", "")], "run_id string, status string, note string"), path)
    tables.append_log(spark.createDataFrame([("r", "running", "x" * 5000)] * 50 + [("r", "finished", "x" * 9000)], "run_id string, status string, note string").coalesce(1), path)
    tables.append_log(spark.createDataFrame([("s", str(i), "") for i in range(40)], "run_id string, status string, note string").repartitionByRange(4, F.col("status").cast("int")), path)
    log = tables.read_log(spark, path, "run_id string, status string, note string").withColumn("output_dir", F.lit(None).cast("string"))
    rows = log.orderBy("line_no").collect()
    assert len(rows) == 92 == len({r["line_no"] for r in rows}) and "_at" not in log.columns
    assert rows[0]["status"] == "started" and rows[51]["status"] == "finished" and [r["status"] for r in rows[52:]] == [str(i) for i in range(40)]
    assert {r["run_id"]: r["status"] for r in runs.latest(log).collect()} == {"r": "finished", "s": "39"}


def test_records_without_a_name_are_runs_of_their_own(spark):
    rows = [(None, None, 1, "a"), (None, "", 2, "b"), ("", "/o", 3, "c"), (None, "/o", 4, "d"), ("r", "/o", 5, "e")]
    df = spark.createDataFrame(rows, "run_id string, output_dir string, line_no long, status string")
    assert sorted(r["status"] for r in runs.latest(df).collect()) == ["a", "b", "d", "e"]


def test_a_bundle_notices_changed_rows(spark, tmp_path):
    b = tables.Bundle(spark, str(tmp_path / "bundle"))
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, name string")
    b.publish({"t": df})
    assert b.problems() == [] and len(b.manifest()["bundle_id"]) == 64
    tables.write_table(df.replace("a", "b", "name"), str(tmp_path / "bundle/t.parquet"), "overwrite")  # as many rows
    assert b.problems() == ["t: other rows than published"]
    tables.write_table(df.repartition(3), str(tmp_path / "bundle/t.parquet"), "overwrite")  # the same rows in other files
    assert b.problems() == []


def test_ties_of_mined_versions_go_to_the_first(spark):
    rows = [("s", v, 0.9) for v in ("v3", "v1", "v2")] + [("s", "v0", 0.5)]
    df = spark.createDataFrame(rows, "stable_source_id string, source_version_id string, p_positive double").repartition(4)
    assert mining.collapse(df).first()["source_version_id"] == "v1"


def test_shares_end_at_one(spark):
    rows = [(g, f"k{k:03d}", 0.1 + (g + 1) * k * 0.01) for g in range(20) for k in range(1 + 7 * g)]
    got = sampling.shares(spark.createDataFrame(rows, "g int, k string, w double"), ["g"], "k", "w").collect()
    for g in range(20):
        own = sorted((r["lo"], r["hi"]) for r in got if r["g"] == g)
        assert own[0][0] == 0 and own[-1][1] == 1.0 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_strata_with_two_movable_sources_have_both_sides():
    """Sources in one stratum or in two, some fixed: lopsided strata stay only where fixed sources alone could mend them."""
    import random

    for round_ in range(300):
        rng = random.Random(round_)
        uids = [f"u{i}" for i in range(rng.randint(1, 12))]
        src = {u: {("g", x): rng.randint(0, 9) for x in rng.sample((0, 1), rng.randint(1, 2))} for u in uids}
        old = {u: rng.choice(["train", "val"]) for u in uids if rng.random() < 0.2}
        sides = split.assign(src, rng.choice([0.01, 0.3, 0.95]), round_, old, small="warn")
        assert all(sides[u] == side for u, side in old.items())
        if not old:
            for stratum in {s for own in src.values() for s in own}:
                own = [u for u in uids if stratum in src[u]]
                alone = [u for u in own if any(sum(s in src[o] for o in uids) < 2 for s in src[u])]
                if len(own) - len(alone) > 1:
                    assert {sides[u] for u in own if u not in alone} == {"train", "val"}, (round_, stratum)


def test_scorer(spark):
    import pandas as pd

    scoring.register_scorer("half", lambda b: pd.DataFrame({"logit0": b["x"] * 0, "logit1": b["x"]}))
    got = scoring.score(spark.createDataFrame([(0.0,), (2.0,)], "x double"), "half", ["x"]).orderBy("x").collect()
    assert got[0]["p"] == 0.5 and abs(got[1]["p"] - 1 / (1 + math.exp(-2))) < 1e-12
    with pytest.raises(KeyError):
        scoring.resolve("none")


def test_stream_counts_equal_batch(spark, tmp_path):
    from tessera.streaming.counters import confusion_stream, read_scores

    rows = scored(spark, [(5.0, 1), (-5.0, 1), (5.0, 0), (-5.0, 0)]).withColumn("game", F.lit("g"))
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = confusion_stream(read_scores(spark, str(tmp_path / "in"), rows.schema), 0.5, ["game"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("counts").collect()] == [("g", 1, 1, 1, 1)]


def test_sidecar_files_carry_their_fingerprint(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", None, 2.0)], "stable_source_id string, negative_subtype string, sample_weight double")
    path = str(tmp_path / "side")
    assert sidecar.read(spark, path) is None
    stamp = sidecar.write(rows, path)
    found = sidecar.read(spark, path)
    assert {r["metadata_fingerprint"] for r in found.collect()} == {stamp} and found.count() == 2
    tables.write_table(found.replace("x", "y", "negative_subtype"), str(tmp_path / "other"))
    with pytest.raises(ValueError):
        sidecar.read(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        sidecar.write(rows.withColumn("sample_weight", F.lit(0.0)), str(tmp_path / "bad"))


def test_mining_manifest_has_its_columns(spark, tmp_path):
    mining.write_manifest(spark.createDataFrame([("s", 0.5, 1)], "stable_source_id string, p_positive float, extra int"), str(tmp_path / "m"))
    got = mining.read_manifest(spark, str(tmp_path / "m"))
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == mining.MANIFEST
    assert tuple(got.first()) == ("s", "", None, 0.5, 0)


def test_dataset_identity_follows_the_files(spark, tmp_path):
    for name, text in (("a/x", "1"), ("a/y", "2"), ("b/x", "1"), ("b/y", "2"), ("c/x", "1"), ("c/y", "3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = {"train": {"index": str(tmp_path / "a"), "copy": str(tmp_path / "b")}, "val": {"index": str(tmp_path / "c")}}
    got = {(r["split"], r["artifact"]): (r["sha256"], r["n_files"]) for r in identity.dataset_identity(spark, paths).collect()}
    assert got["train", "index"] == got["train", "copy"] != got["val", "index"] and got["val", "index"][1] == 2
    assert identity.components_fingerprint({"a": None, "b": ""}) == "" != identity.components_fingerprint({"a": "1", "b": None}) == identity.components_fingerprint({"a": "1"})
