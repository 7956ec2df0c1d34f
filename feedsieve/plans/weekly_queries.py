"""The flagship query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from feedsieve.operators import translate
from feedsieve.plans import sql as q
from feedsieve.plans.adapters import TEST_POLICY, episodes, feed_config, with_episodes
from feedsieve.plans.catalog import query
from feedsieve.plans.derive_queries import _STOP, _VERDICT
from feedsieve.plans.weekly import REGISTRY, run_week, screen, weekly_top
from feedsieve.session import new_folder
from feedsieve.sources import runs

P = TEST_POLICY
EPISODE_ID = f"""podcast_id || '_' || replace(publish_date, '-', '') || '_' || lower(array_to_string(list_filter(
  regexp_extract_all(episode_title, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, lower(w)))[1:3], '_')) || '_' || left(sha1(episode_title), 8)"""
UNIQUE = f"""
named AS (SELECT *, {EPISODE_ID} AS episode_id FROM episodes),
once AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY podcast_id, episode_id ORDER BY item_pos) = 1),
uniq AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY episode_title || publish_date ORDER BY feed_ord, item_pos) = 1)
"""
SCREENED = (UNIQUE, q.scored(P).replace("FROM episodes)", "FROM uniq)"), q.classified(P, "judged"), f"""
decided AS (SELECT *, {_VERDICT} AS decision FROM classified),
ranked AS (SELECT week_id, final_score, row_number() OVER (PARTITION BY week_id ORDER BY final_score DESC) AS rn, count(*) OVER (PARTITION BY week_id) AS n FROM decided WHERE decision = 'preview'),
cuts AS (SELECT week_id, max(n) AS n, max(CASE WHEN rn = greatest(0, CAST(floor(n * 2e-1) AS BIGINT) - 1) + 1 THEN final_score END) AS upper_cut,
  max(CASE WHEN rn = greatest(0, CAST(floor(n * 6e-1) AS BIGINT) - 1) + 1 THEN final_score END) AS lower_cut FROM ranked GROUP BY week_id),
screened AS (SELECT d.*, CASE WHEN d.decision <> 'preview' OR c.n < 2 THEN 'medium'
  WHEN d.final_score >= (CASE WHEN c.n >= 5 THEN upper_cut ELSE (upper_cut + lower_cut) / 2 END) THEN 'high' WHEN d.final_score >= lower_cut THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN topic_relevance <= 0 AND greatest(strategic_value, actionability) < 40 THEN 'no' WHEN final_score >= {P.yes_score} OR transcription_value >= {P.yes_transcription} THEN 'yes'
    WHEN final_score >= {P.maybe_score} OR transcription_value >= {P.maybe_transcription} THEN 'maybe' ELSE 'no' END AS full_suggestion
  FROM decided d LEFT JOIN cuts c USING (week_id))
""")


@query("weekly_screen", with_episodes("""
SELECT week_id, podcast_id, item_pos, feed_ord, episode_id, final_score, decision, reason_code AS decision_reason_code, full_suggestion, priority, CAST(place AS INT) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY week_id ORDER BY final_score DESC, decision, feed_ord, item_pos) AS place FROM screened WHERE decision <> 'skip') WHERE place <= 3""", *SCREENED))
def weekly_screen(spark, sf):
    return weekly_top(episodes(spark, sf), P)


@query("weekly_decisions", with_episodes("""
SELECT item_pos, week_id, final_score, decision, reason_code AS decision_reason_code, priority, full_suggestion FROM screened""", *SCREENED))
def weekly_decisions(spark, sf):
    return screen(episodes(spark, sf), P).select("item_pos", "week_id", "final_score", "decision", "decision_reason_code", "priority", "full_suggestion")


CUT = "2024-01-14 14:00:00"
EARLY = f"""
early AS (SELECT * FROM (SELECT * FROM named WHERE pub_ts < TIMESTAMP '{CUT}') QUALIFY row_number() OVER (PARTITION BY podcast_id, episode_id ORDER BY item_pos) = 1),
known AS (SELECT * FROM early QUALIFY row_number() OVER (PARTITION BY episode_title || publish_date ORDER BY feed_ord, item_pos) = 1)
"""


def _two_runs(spark, sf, policy):
    """The weeks before CUT as one run, then all weeks as the next, with the registry of the first."""
    eps = episodes(spark, sf)
    hosts = feed_config(spark, sf).select(F.col("name").alias("podcast_name"), F.concat(F.lit("Host "), F.col("id")).alias("host"))
    root = new_folder(spark, "weekly")
    run_week(eps.filter(F.col("pub_ts") < F.lit(CUT).cast("timestamp")), policy, hosts, root, "2024-01-15", with_report=False)
    done = run_week(eps, policy, hosts, root, "2024-02-05", with_report=False)
    stored = runs.read_version(spark, f"{root}/registry", REGISTRY).select("episode_id", F.col("seen_count").alias("stored_count"), F.array_join("statuses", ",").alias("history"))
    return done.join(stored, "episode_id").select("item_pos", "week_id", "episode_id", "decision", "priority", "final_score", "seen_count", "stored_count", "first_seen", "last_seen", "history",
                                                  (F.length("reason_zh") > 0).alias("explained"))


_KNOWN = "k.episode_id IS NOT NULL"
_REGISTERED = f"""CAST(CASE WHEN {_KNOWN} THEN 2 ELSE 1 END AS INT) AS seen_count, CAST(CASE WHEN {_KNOWN} THEN 2 ELSE 1 END AS INT) AS stored_count,
  CASE WHEN {_KNOWN} THEN '2024-01-15' ELSE '2024-02-05' END AS first_seen, '2024-02-05' AS last_seen"""


@query("weekly_run", with_episodes(f"""
SELECT s.item_pos, s.week_id, s.episode_id, s.decision, s.priority, s.final_score, {_REGISTERED}, CASE WHEN {_KNOWN} THEN s.decision || ',' ELSE '' END || s.decision AS history, true AS explained
FROM screened s LEFT JOIN known k USING (episode_id)""", *SCREENED, EARLY))
def weekly_run(spark, sf):
    return _two_runs(spark, sf, P)


S = replace(P, mode="score_based")
_LIMITED = f"""
placed AS (SELECT *, row_number() OVER (PARTITION BY week_id, score_decision ORDER BY final_score DESC, feed_ord, item_pos) AS place FROM judged),
limited AS (SELECT *, CASE WHEN score_decision = 'full' AND place > {P.weekly_full_limit} THEN 'preview' WHEN score_decision = 'preview' AND place > {P.weekly_preview_limit} THEN 'skip' ELSE score_decision END AS final
  FROM placed),
before AS (SELECT *, CASE WHEN score_decision = 'full' AND place > {P.weekly_full_limit} THEN 'full,preview' WHEN score_decision = 'preview' AND place > {P.weekly_preview_limit} THEN 'preview,skip' ELSE score_decision END AS past
  FROM (SELECT j.*, row_number() OVER (PARTITION BY j.week_id, j.score_decision ORDER BY j.final_score DESC, j.feed_ord, j.item_pos) AS place FROM judged_early j))"""


@query("weekly_run_by_score", with_episodes(f"""
SELECT l.item_pos, l.week_id, l.episode_id, l.final AS decision, CASE WHEN l.final_score >= 70 THEN 'high' WHEN l.final_score >= 40 THEN 'medium' ELSE 'low' END AS priority, l.final_score, {_REGISTERED},
  CASE WHEN {_KNOWN} THEN k.past || ',' ELSE '' END || CASE WHEN l.final <> l.score_decision THEN l.score_decision || ',' ELSE '' END || l.final AS history, true AS explained
FROM limited l LEFT JOIN before k ON k.episode_id = l.episode_id""", UNIQUE, EARLY, q.scored(P).replace("FROM episodes)", "FROM uniq)"),
    "judged_early AS (SELECT j.* FROM judged j JOIN known n ON n.item_pos = j.item_pos)", _LIMITED))
def weekly_run_by_score(spark, sf):
    return _two_runs(spark, sf, S)


@query("weekly_report", with_episodes("""
SELECT week_id, count(*) AS items, '总计扫描：' || count(*) || '期节目' AS total_line, '覆盖播客：' || count(DISTINCT podcast_id) || '个' AS feeds_line,
  count(*) FILTER (decision <> 'skip') AS shown, count(*) FILTER (decision = 'skip') AS reasons
FROM screened GROUP BY week_id""", *SCREENED))
def weekly_report(spark, sf):
    """What the stored report of a run with translation says of every week."""
    eps = episodes(spark, sf)
    hosts = feed_config(spark, sf).select(F.col("name").alias("podcast_name"), F.concat(F.lit("Host "), F.col("id")).alias("host"))
    root = new_folder(spark, "weekly")
    run_week(eps, P, hosts, root, "2024-02-05", translate.mock_translate)
    lines = spark.read.schema("line_no bigint, line string, week_id string, run_id string").parquet(f"{root}/report")
    line = F.col("line")
    return lines.groupBy("week_id").agg(
        F.count_if(line.startswith("### Show ")).alias("items"), F.max(F.when(line.startswith("总计扫描："), line)).alias("total_line"), F.max(F.when(line.startswith("覆盖播客："), line)).alias("feeds_line"),
        F.count_if(line.startswith("### ") & line.rlike("分 \\| (Full|Preview)$")).alias("shown"), F.count_if(line.startswith("**跳过理由：**")).alias("reasons"))
