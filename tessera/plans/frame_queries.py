"""Queries over frames: pairs, videos, sources, identities, splits, audits, metadata."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tessera.operators import audit, identity, packed, pairs, sampling, sidecar, split
from tessera.plans import views as V
from tessera.session import load

GROUPS = """one AS (
  SELECT f.*, {uid} AS uid,
    (SELECT count(*) FROM frames x WHERE x.game = f.game AND x.label = f.label AND x.video_id = f.video_id AND x.frame_id = f.frame_id + 1) AS p1,
    (SELECT count(*) FROM frames x WHERE x.game = f.game AND x.label = f.label AND x.video_id = f.video_id AND x.frame_id = f.frame_id + 2) AS p2,
    (SELECT count(*) FROM frames x WHERE x.game = f.game AND x.label = f.label AND x.video_id = f.video_id AND x.frame_id = f.frame_id + 3) AS p3
  FROM frames f),
grp AS (
  SELECT game, uid AS stable_source_id, list_sort(list_distinct(list(label))) AS labels,
    {sums} FROM one GROUP BY game, uid)"""
_SUMS = ",\n    ".join(
    f"CAST(count(*) FILTER (label = {x}) AS BIGINT) AS frame_count_label{x}, " + ", ".join(f"CAST(coalesce(sum(p{d}) FILTER (label = {x}), 0) AS BIGINT) AS valid_pair_count_label{x}_delta{d}" for d in (1, 2, 3)) for x in (0, 1)
)


def _groups_sql(mode: str) -> str:
    uid = "game || '::' || video_id" if mode == "game_video" else "game || '::' || CAST(label AS VARCHAR) || '::' || video_id"
    return GROUPS.format(uid=uid, sums=_SUMS)


def _as_text(groups):
    return groups.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


def pair_counts_by_game_label_delta(spark, d):
    return pairs.pair_counts(V.frames(spark, d))


def pairs_delta2(spark, d):
    return pairs.build_pairs(V.frames(spark, d), 2)


def pairs_all_deltas(spark, d):
    return pairs.enumerate_pairs(V.frames(spark, d)).groupBy("game", "label", "delta").agg(F.count(F.lit(1)).alias("n"), F.sum("frame1_id").alias("sum_frame1"), F.count_distinct("video_id").alias("n_videos"))


def video_summary(spark, d):
    return pairs.summarize_videos(V.frames(spark, d))


def turn_summary(spark, d):
    turns = load(spark, d, "conversations").select(F.lit("chat").alias("game"), (F.col("role") == "user").cast("int").alias("label"), F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("frame_id"))
    return pairs.summarize_videos(turns)


def video_entry_arrays(spark, d):
    e = pairs.video_entries(V.frames(spark, d))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return e.select("game", "label", "video_id", text("frame_ids").alias("frame_ids"), *[text(f"valid_starts_delta{k}").alias(f"starts{k}") for k in (1, 2, 3)])


def source_groups_game_video(spark, d):
    return _as_text(pairs.source_groups(V.frames(spark, d), "game_video"))


def source_groups_game_label_video(spark, d):
    return _as_text(pairs.source_groups(V.frames(spark, d), "game_label_video"))


def source_identity_precheck(spark, d):
    return pairs.identity_precheck(pairs.source_groups(V.frames(spark, d), "game_video"))


def strata_totals(spark, d):
    return pairs.strata(pairs.source_groups(V.frames(spark, d), "game_video"), 2)


def games_missing_labels(spark, d):
    return pairs.games_missing_labels(V.docs(spark, d).select("game", "video_id", "label").withColumn("game", F.concat_ws("/", "game", F.col("video_id"))))


def split_report(spark, d):
    return pairs.split_report(V.frames(spark, d))


def eval_pair_subsample(spark, d):
    positioned = pairs.ordered_positions(pairs.build_pairs(V.frames(spark, d), 2))
    return pairs.subsample(positioned, 997).select("position", "game", "label", "video_id", "frame0_id")


def eval_rank_shard(spark, d):
    positioned = pairs.ordered_positions(pairs.enumerate_pairs(V.frames(spark, d)))
    return pairs.shard(positioned, 3, 8).groupBy("delta", "game", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("sum_position"))


def index_bytes(spark, d):
    return pairs.index_bytes(pairs.video_entries(V.frames(spark, d)))


def capped_starts(spark, d):
    capped = pairs.cap_starts(pairs.video_entries(V.frames(spark, d)), 2)
    return capped.groupBy("game", "label").agg(*[F.sum(F.size(f"valid_starts_delta{k}")).alias(f"n{k}") for k in (1, 2, 3)])


def stable_rank_order(spark, d):
    groups = V.frames(spark, d).select(F.concat_ws("::", "game", "video_id").alias("stable_source_id")).distinct()
    return groups.select("stable_source_id", split.rank(17, "stable_source_id").alias("rank"))


def content_version_id(spark, d):
    return identity.content_version_ids(V.docs(spark, d), ["stable_source_id"])


def dataset_fingerprint(spark, d):
    return identity.fingerprint(V.docs(spark, d), ["game", "label", "video_id", "frame_id", "content_sha256"], 64)


def dataset_fingerprint_bucketed(spark, d):
    return identity.bucketed_fingerprint(V.docs(spark, d), ["game", "label", "video_id", "frame_id", "content_sha256"], 64)


def content_hash_coverage(spark, d):
    return identity.covers_content(V.docs(spark, d))


def duplicate_content_groups(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return audit.content_duplicates(V.docs(spark, d)).select("content_sha256", "n", text("labels"), text("splits"), "kind", "severity")


def duplicate_samples(spark, d):
    docs = V.docs(spark, d)
    return audit.duplicate_samples(docs, audit.content_duplicates(docs), 2).select("content_sha256", "sample", "split", "game", "label", "video_id", "frame_id")


def repeated_names(spark, d):
    return audit.repeated_names(V.docs(spark, d))


def cross_split_video_overlap(spark, d):
    return audit.split_overlap(V.docs(spark, d), ["game", "label", "video_id"])


def cross_split_source_overlap(spark, d):
    return audit.split_overlap(V.docs(spark, d), ["stable_source_id"])


def overlap_content_classification(spark, d):
    return audit.overlap_content(V.docs(spark, d))


def audit_violations(spark, d):
    docs = V.docs(spark, d)
    counts = None
    for name in ("train", "val", "test"):
        part = pairs.pair_counts(docs.where(F.col("split") == name)).withColumn("split", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    found = audit.violations(docs, counts, audit.content_duplicates(docs))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


def _entries(spark, d):
    docs = load(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("stable_source_id"), F.when(F.col("lang") == "en", "english").alias("negative_subtype"), F.lit(1.0).alias("sample_weight"))


def sidecar_left_join(spark, d):
    return sidecar.enrich(_entries(spark, d), V.sidecar(spark, d))


def sidecar_orphans(spark, d):
    """Labelled sources without a frame."""
    return sidecar.orphans(V.sidecar(spark, d), V.frames(spark, d).select(F.col("video_id").alias("stable_source_id")).distinct())


def sidecar_upsert(spark, d):
    existing = V.sidecar(spark, d).withColumn("negative_subtype", F.nullif("negative_subtype", F.lit("")))
    incoming = _entries(spark, d).select("stable_source_id", "negative_subtype")
    return sidecar.upsert(existing, incoming, "overwrite")[0]


def sidecar_conflicts(spark, d):
    existing = V.sidecar(spark, d).withColumn("negative_subtype", F.nullif("negative_subtype", F.lit("")))
    return sidecar.upsert(existing, _entries(spark, d).select("stable_source_id", "negative_subtype"), "refuse")[1]


def packed_layout(spark, d):
    return packed.layout(V.frames(spark, d), 4096, 3 * 16 * 16)


def packed_contiguity(spark, d):
    return packed.contiguity(packed.layout(V.frames(spark, d)))


#: Columns that are indexes of their tables, or are not.
_INDEXES = [("nation", "n_nationkey"), ("region", "r_regionkey"), ("events", "event_id"), ("events", "user_id"), ("lineitem", "l_orderkey"), ("documents", "doc_id")]


def contiguity_checks(spark, d):
    checks = [packed.contiguity(load(spark, d, t).select(F.col(c).alias("frame_index"))).select(F.lit(f"{t}.{c}").alias("indexes"), "n", "contiguous") for t, c in _INDEXES]
    return functools.reduce(lambda a, b: a.unionByName(b), checks)


def greedy_split(spark, d):
    return split.split(pairs.source_groups(V.frames(spark, d), "game_video"), 0.2, 17).select("game", "stable_source_id", "split", "fresh")


def extend_split(spark, d):
    groups = pairs.source_groups(V.frames(spark, d), "game_video")
    old = groups.where("crc32(stable_source_id) % 4 <> 0").select("stable_source_id", F.when(F.crc32("stable_source_id") % 5 == 0, "val").otherwise("train").alias("split"))
    return split.split(groups, 0.2, 17, existing=old)


def split_summary(spark, d):
    groups = pairs.source_groups(V.frames(spark, d), "game_video")
    sides = groups.select("stable_source_id", F.when(split.rank(17, "stable_source_id") < "3", "val").otherwise("train").alias("split"))
    return split.summary(groups, sides)


def expected_game_probabilities(spark, d):
    return sampling.game_probabilities(V.frames(spark, d), 0.5).withColumn("probability", F.round("probability", 9))


def hash_sampling(spark, d):
    u = sampling.uniform(7, 1, F.col("step"), F.col("slot"), "delta")
    drawn = sampling.slots(spark, 50, 64).withColumn("u", u)
    return drawn.select("step", "slot", F.round("u", 12).alias("u"), sampling.pick(F.col("u"), {1: 0.2, 2: 0.7, 3: 0.1}).alias("delta"))


def hierarchical_sampling(spark, d):
    entries = pairs.video_entries(V.frames(spark, d)).select("game", "label", "video_id", F.lit(1.0).alias("sample_weight"), F.when(F.crc32("video_id") % 3 == 0, "hard").otherwise("ordinary").alias("bucket"), *[F.col(f"valid_starts_delta{k}").alias(f"starts_{k}") for k in (1, 2, 3)])
    return sampling.draw(entries, sampling.slots(spark, 20, 32), 7, 0, {1: 0.2, 2: 0.7, 3: 0.1}, {0: 0.5, 1: 0.5}, 0.5, {"hard": 0.3, "ordinary": 0.7})


def bucket_summary(spark, d):
    side = V.sidecar(spark, d).select("stable_source_id", F.col("negative_subtype"))
    docs = V.docs(spark, d).select("game", F.lit(0).alias("label"), "video_id", F.lit(1).alias("n"), F.concat_ws("", F.col("video_id")).alias("stable_source_id")).join(side, "stable_source_id", "left")
    return sampling.bucket_summary(sampling.buckets(docs, ["toxic"], [""]), "n", 3)


ONE = "WITH " + V.FRAMES
_GV = "WITH " + V.FRAMES + ", " + _groups_sql("game_video")
_PAIRS = """pr AS (SELECT a.game, a.label, a.video_id, a.frame_id AS frame0_id, b.frame_id AS frame1_id, d.delta FROM frames a, (VALUES (1), (2), (3)) d(delta), frames b
  WHERE a.game = b.game AND a.label = b.label AND a.video_id = b.video_id AND b.frame_id = a.frame_id + d.delta)"""
_SUMMARY = """SELECT game, label, video_id, count(*) AS frame_count, min(frame_id) AS first_frame, max(frame_id) AS last_frame, {0}
 FROM {1} f GROUP BY game, label, video_id"""
_OVERLAP = """SELECT DISTINCT a.split AS left_split, b.split AS right_split, {0} FROM docs a JOIN docs b USING ({1})
 WHERE (a.split = 'train' AND b.split IN ('val', 'test')) OR (a.split = 'val' AND b.split = 'test')"""


def _pair_sums(table: str) -> str:
    return ", ".join(
        f"CAST(sum((SELECT count(*) FROM {table} x WHERE x.game = f.game AND x.label = f.label AND x.video_id = f.video_id AND x.frame_id = f.frame_id + {k})) AS BIGINT) AS pairs_delta{k}" for k in (1, 2, 3)
    )


_DUPES = """dup AS (SELECT content_sha256, count(*) AS n, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS labels,
  string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT label) AS nl, count(DISTINCT split) AS ns FROM docs GROUP BY content_sha256 HAVING count(*) > 1)"""
_KIND = "CASE WHEN nl > 1 THEN 'identical_content_with_conflicting_labels' WHEN ns > 1 THEN 'same_label_content_overlap_across_splits' ELSE 'duplicate_content_within_split' END"
_DOC_FP = """fp AS (SELECT sha256(concat_ws('|', game, CAST(label AS VARCHAR), video_id, CAST(frame_id AS VARCHAR), content_sha256)) AS h FROM docs),
bk AS (SELECT CAST(('0x' || substr(h, 1, 2))::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY h)) AS fingerprint FROM fp GROUP BY 1)"""
_ENTRIES = "ent AS (SELECT CAST(doc_id AS VARCHAR) AS stable_source_id, CASE WHEN lang = 'en' THEN 'english' END AS negative_subtype FROM documents)"
_ORDERED = "pos AS (SELECT *, row_number() OVER (ORDER BY delta, game, label, video_id, frame0_id) - 1 AS position FROM {0})"
_LAYOUT = "lay AS (SELECT *, row_number() OVER (ORDER BY game, label, video_id, frame_id) - 1 AS frame_index FROM frames)"

SQL = {
    "pair_counts_by_game_label_delta": f"{ONE}, {_PAIRS} SELECT f.game, f.label, f.delta, count(p.frame0_id) AS n_pairs FROM (SELECT DISTINCT game, label, delta FROM frames, (VALUES (1), (2), (3)) d(delta)) f LEFT JOIN pr p USING (game, label, delta) GROUP BY 1, 2, 3",
    "pairs_delta2": f"{ONE} SELECT a.game, a.label, a.video_id, a.frame_id AS frame0_id, b.frame_id AS frame1_id, 2 AS delta FROM frames a JOIN frames b ON b.game = a.game AND b.label = a.label AND b.video_id = a.video_id AND b.frame_id = a.frame_id + 2",
    "pairs_all_deltas": f"{ONE}, {_PAIRS} SELECT game, label, delta, count(*) AS n, CAST(sum(frame1_id) AS BIGINT) AS sum_frame1, count(DISTINCT video_id) AS n_videos FROM pr GROUP BY 1, 2, 3",
    "video_summary": ONE + " " + _SUMMARY.format(_pair_sums("frames"), "frames"),
    "turn_summary": "WITH turns AS (SELECT DISTINCT 'chat' AS game, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label, CAST(conv_id AS VARCHAR) AS video_id, CAST(turn AS INTEGER) AS frame_id FROM conversations) " + _SUMMARY.format(_pair_sums("turns"), "turns"),
    "video_entry_arrays": ONE + ", e AS (SELECT game, label, video_id, list_sort(list(frame_id)) AS ids FROM frames GROUP BY 1, 2, 3) SELECT game, label, video_id, array_to_string(ids, ',') AS frame_ids, "
    + ", ".join(f"coalesce(array_to_string([i - 1 FOR i IN range(1, len(ids) + 1) IF list_contains(ids, ids[i] + {k})], ','), '') AS starts{k}" for k in (1, 2, 3)) + " FROM e",
    "source_groups_game_video": _GV + " SELECT * REPLACE (array_to_string(labels, ',') AS labels) FROM grp",
    "source_groups_game_label_video": "WITH " + V.FRAMES + ", " + _groups_sql("game_label_video") + " SELECT * REPLACE (array_to_string(labels, ',') AS labels) FROM grp",
    "source_identity_precheck": _GV + " SELECT game, CAST(count(*) FILTER (len(labels) = 1) AS BIGINT) AS single_label_sources, CAST(count(*) FILTER (len(labels) > 1) AS BIGINT) AS mixed_label_sources, "
    + ", ".join(f"CAST(sum(frame_count_label{x}) AS BIGINT) AS frames_label{x}, CAST(sum(valid_pair_count_label{x}_delta2) AS BIGINT) AS pairs_label{x}" for x in (0, 1)) + " FROM grp GROUP BY game",
    "strata_totals": _GV + " SELECT game, 0 AS label, count(*) AS n_sources, CAST(sum(valid_pair_count_label0_delta2) AS BIGINT) AS total_pairs FROM grp WHERE list_contains(labels, 0) GROUP BY game UNION ALL SELECT game, 1, count(*), CAST(sum(valid_pair_count_label1_delta2) AS BIGINT) FROM grp WHERE list_contains(labels, 1) GROUP BY game",
    "games_missing_labels": "WITH " + V.DOCS + " SELECT g AS game, x AS missing_label FROM (SELECT DISTINCT game || '/' || video_id AS g FROM docs), (VALUES (0), (1)) l(x) WHERE NOT EXISTS (SELECT 1 FROM docs WHERE game || '/' || video_id = g AND label = x)",
    "split_report": ONE + " SELECT CASE WHEN grouping(game) = 0 AND grouping(label) = 0 THEN 'game_label' WHEN grouping(game) = 0 THEN 'game' WHEN grouping(label) = 0 THEN 'label' ELSE 'all' END AS level, game, label, count(*) AS n_frames, count(DISTINCT (game, label, video_id)) AS n_videos FROM frames GROUP BY CUBE (game, label)",
    "eval_pair_subsample": f"{ONE}, {_PAIRS}, p2 AS (SELECT * FROM pr WHERE delta = 2), " + _ORDERED.format("p2") + ", n AS (SELECT count(*) AS n FROM p2) SELECT position, game, label, video_id, frame0_id FROM pos, n WHERE n <= 997 OR position IN (SELECT CASE WHEN i = 996 THEN n - 1 ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / 996)) AS BIGINT) END FROM range(0, 997) r(i), n)",
    "eval_rank_shard": f"{ONE}, {_PAIRS}, " + _ORDERED.format("pr") + " SELECT delta, game, label, count(*) AS n, CAST(sum(position) AS BIGINT) AS sum_position FROM pos WHERE position % 8 = 3 GROUP BY 1, 2, 3",
    "index_bytes": f"{ONE}, {_PAIRS} SELECT game, CAST(sum(b) AS BIGINT) AS payload_bytes FROM (SELECT game, sum(4) AS b FROM frames GROUP BY 1 UNION ALL SELECT game, sum(4) FROM pr GROUP BY 1 UNION ALL SELECT game, sum(strlen(game) + strlen(video_id)) FROM (SELECT DISTINCT game, label, video_id FROM frames) GROUP BY 1) GROUP BY game",
    "capped_starts": f"{ONE}, {_PAIRS}, c AS (SELECT game, label, video_id, delta, least(2, count(*)) AS n FROM pr GROUP BY 1, 2, 3, 4) SELECT f.game, f.label, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (delta = {k}), 0) AS BIGINT) AS n{k}" for k in (1, 2, 3)) + " FROM (SELECT DISTINCT game, label FROM frames) f LEFT JOIN c USING (game, label) GROUP BY 1, 2",
    "stable_rank_order": ONE + " SELECT DISTINCT game || '::' || video_id AS stable_source_id, substr(sha256('17:' || game || '::' || video_id), 1, 16) AS rank FROM frames",
    "content_version_id": "WITH " + V.DOCS + " SELECT stable_source_id, sha256(CAST(count(*) AS VARCHAR) || '|' || string_agg(CAST(label AS VARCHAR) || ':' || CAST(frame_id AS VARCHAR) || ':' || content_sha256, '|' ORDER BY label, frame_id, content_sha256)) AS content_version_id FROM docs GROUP BY 1",
    "dataset_fingerprint": f"WITH {V.DOCS}, {_DOC_FP} SELECT CAST(sum(n_rows) AS BIGINT) AS n_rows, sha256(string_agg(fingerprint, '' ORDER BY bucket)) AS fingerprint FROM bk",
    "dataset_fingerprint_bucketed": f"WITH {V.DOCS}, {_DOC_FP} SELECT * FROM bk",
    "content_hash_coverage": "WITH " + V.DOCS + " SELECT count(*) > 0 AND bool_and(content_sha256 <> '') AS content_hash_check_enabled FROM docs",
    "duplicate_content_groups": f"WITH {V.DOCS}, {_DUPES} SELECT content_sha256, n, labels, splits, {_KIND} AS kind, CASE WHEN nl > 1 THEN 'error' ELSE 'warning' END AS severity FROM dup",
    "duplicate_samples": f"WITH {V.DOCS}, {_DUPES} SELECT * FROM (SELECT content_sha256, CAST(row_number() OVER (PARTITION BY content_sha256 ORDER BY split, game, label, video_id, frame_id, path) AS INTEGER) AS sample, split, game, label, video_id, frame_id FROM docs SEMI JOIN dup USING (content_sha256)) WHERE sample <= 2",
    "repeated_names": f"WITH {V.DOCS} SELECT count(*) AS group_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS record_count FROM (SELECT count(*) AS n FROM docs GROUP BY video_id HAVING count(*) > 1)",
    "cross_split_video_overlap": "WITH " + V.DOCS + " " + _OVERLAP.format("game, label, video_id", "game, label, video_id"),
    "cross_split_source_overlap": "WITH " + V.DOCS + " " + _OVERLAP.format("stable_source_id", "stable_source_id"),
    "overlap_content_classification": "WITH " + V.DOCS + ", o AS (" + _OVERLAP.format("stable_source_id", "stable_source_id") + """),
s AS (SELECT left_split, right_split, stable_source_id, content_sha256 FROM o JOIN docs USING (stable_source_id) WHERE split IN (left_split, right_split) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT split) = 2),
n AS (SELECT left_split, right_split, stable_source_id, count(*) AS n FROM s JOIN docs USING (stable_source_id, content_sha256) WHERE split IN (left_split, right_split) GROUP BY 1, 2, 3)
SELECT left_split, right_split, stable_source_id, coalesce(n, 0) AS shared_content_frames, CASE WHEN coalesce(n, 0) = 0 THEN 'numbering collision' ELSE 'real leakage' END AS hint FROM o LEFT JOIN n USING (left_split, right_split, stable_source_id)""",
    "audit_violations": f"WITH {V.DOCS}, {_DUPES}, o AS (" + _OVERLAP.format("stable_source_id", "stable_source_id") + """),
v AS (
  SELECT 'missing_label' AS rule, split || '/' || game AS subject FROM docs GROUP BY split, game HAVING count(DISTINCT label) < 2
  UNION ALL SELECT 'no_legal_pairs', s FROM (VALUES ('val'), ('test')) x(s) WHERE NOT EXISTS (SELECT 1 FROM docs a JOIN docs b ON a.split = s AND b.split = s AND a.game = b.game AND a.label = b.label AND a.video_id = b.video_id AND b.frame_id = a.frame_id + 2) AND (s = 'test' OR EXISTS (SELECT 1 FROM docs WHERE split = s))
  UNION ALL SELECT 'missing_split', 'train' WHERE NOT EXISTS (SELECT 1 FROM docs WHERE split = 'train')
  UNION ALL SELECT 'duplicate_content', content_sha256 FROM dup WHERE nl > 1 OR ns > 1
  UNION ALL SELECT 'source_in_two_splits', stable_source_id FROM o)
SELECT rule, count(*) AS n, min(subject) AS first_subject FROM v GROUP BY rule""",
    "sidecar_left_join": f"WITH {V.SIDECAR}, {_ENTRIES} SELECT stable_source_id, coalesce(nullif(s.negative_subtype, ''), e.negative_subtype) AS negative_subtype, coalesce(s.sample_weight, 1.0::DOUBLE) AS sample_weight FROM ent e LEFT JOIN side s USING (stable_source_id)",
    "sidecar_orphans": f"WITH {V.SIDECAR}, {V.FRAMES} SELECT stable_source_id FROM side WHERE stable_source_id NOT IN (SELECT video_id FROM frames)",
    "sidecar_upsert": f"""WITH {V.SIDECAR}, {_ENTRIES},
old AS (SELECT stable_source_id, nullif(negative_subtype, '') AS s, sample_weight AS w, TRUE AS had FROM side),
new AS (SELECT stable_source_id, negative_subtype AS t, TRUE AS got FROM ent)
SELECT stable_source_id, coalesce(t, s) AS negative_subtype, coalesce(w, 1.0::DOUBLE) AS sample_weight,
  CASE WHEN had IS NULL THEN 'new' WHEN t IS NOT NULL AND t IS DISTINCT FROM s THEN 'updated' ELSE 'unchanged' END AS status
FROM old FULL JOIN new USING (stable_source_id)""",
    "sidecar_conflicts": f"WITH {V.SIDECAR}, {_ENTRIES} SELECT stable_source_id, s.negative_subtype AS current, e.negative_subtype AS incoming FROM side s JOIN ent e USING (stable_source_id) WHERE nullif(s.negative_subtype, '') <> e.negative_subtype",
    "packed_layout": f"{ONE}, {_LAYOUT} SELECT game, label, video_id, frame_id, frame_index, frame_index // 4096 AS shard_id, (frame_index % 4096) * 768 AS \"offset\" FROM lay",
    "packed_contiguity": f"{ONE}, i AS (SELECT row_number() OVER (ORDER BY game, label, video_id, frame_id) - 1 AS i FROM frames) SELECT count(*) AS n, min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AS contiguous FROM i",
    "contiguity_checks": " UNION ALL ".join(f"SELECT '{t}.{c}' AS indexes, count(*) AS n, coalesce(min({c}) = 0 AND max({c}) = count(*) - 1 AND count(DISTINCT {c}) = count(*), TRUE) AS contiguous FROM {t}" for t, c in _INDEXES),
    "split_summary": _GV + ", s AS (SELECT *, CASE WHEN substr(sha256('17:' || stable_source_id), 1, 16) < '3' THEN 'val' ELSE 'train' END AS side FROM grp), e AS ("
    + " UNION ALL ".join(f"SELECT side, {k} AS delta, valid_pair_count_label0_delta{k} + valid_pair_count_label1_delta{k} AS n FROM s" for k in (1, 2, 3))
    + ") SELECT delta, CAST(coalesce(sum(n) FILTER (side = 'train'), 0) AS BIGINT) AS train_pairs, CAST(coalesce(sum(n) FILTER (side = 'val'), 0) AS BIGINT) AS val_pairs, round(coalesce(CAST(sum(n) FILTER (side = 'val') AS DOUBLE) / sum(n), 0), 6) AS val_share FROM e GROUP BY delta",
    "expected_game_probabilities": ONE + ", n AS (SELECT game, count(DISTINCT (label, video_id)) AS n_videos FROM frames GROUP BY game) SELECT game, n_videos, round(pow(n_videos, CAST(0.5 AS DOUBLE)) / sum(pow(n_videos, CAST(0.5 AS DOUBLE))) OVER (), 9) AS probability FROM n",
    "hash_sampling": "WITH g AS (SELECT CAST(s AS INTEGER) AS step, CAST(k AS INTEGER) AS slot FROM range(0, 50) a(s), range(0, 64) b(k)), u AS (SELECT step, slot, CAST(('0x' || substr(sha256('7|1|' || step || '|' || slot || '|delta|0'), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496 AS u FROM g) SELECT step, slot, round(u, 12) AS u, CASE WHEN u < CAST(0.2 AS DOUBLE) / 1.0 THEN 1 WHEN u < CAST(0.2 AS DOUBLE) + CAST(0.7 AS DOUBLE) THEN 2 ELSE 3 END AS delta FROM u",
    "bucket_summary": f"WITH {V.DOCS}, {V.SIDECAR}, b AS (SELECT game, video_id, CASE WHEN negative_subtype = 'toxic' THEN 'hard' WHEN negative_subtype = '' THEN 'ordinary' ELSE 'excluded' END AS bucket FROM docs LEFT JOIN side ON stable_source_id_ = video_id) SELECT game, bucket, count(DISTINCT video_id) AS n_videos, count(*) AS n_pairs, count(DISTINCT video_id) < 3 AS undersized FROM b GROUP BY 1, 2".replace("side ON stable_source_id_", "side ON side.stable_source_id"),
}
