"""Registered queries of learner state and next actions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import learner as ln
from lectern.plans import carriers as c

NOW = "2024-02-01 00:00:00"


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _missions(spark, sf):
    """One mission a user; its settings follow from the number."""
    a = c.k_attempts(spark, sf)
    m = a.groupBy("mission_id").agg(F.max_by("concept", "sequence").alias("concept"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    i = F.col("mission_id")
    return m.select(
        "mission_id", "concept",
        F.when(i % 10 == 0, _pick(("PLANNED", "PAUSED", "COMPLETED", "STOPPED"), F.floor(i / 10) % 4)).otherwise("ACTIVE").alias("status"),
        _pick(("UNDERSTANDING", "RETRIEVAL", "CONNECTION", "APPLICATION", "PREREQUISITE_SUPPORT", "FEEDBACK", "REFLECTION", "EVIDENCE_UPDATE"), i % 8).alias("stage"),
        (F.lit(30) + i % 40).alias("available_minutes"),
        F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast(mission_id % 45 as int), 0)").alias("started_at"),
        _pick(("STRICT_SOURCE", "SOURCE_FIRST", "GENERAL_KNOWLEDGE"), i % 3).alias("grounding"),
        _pick(("READY", "READY", "LIMITED", "ABSENT"), F.floor(i / 3) % 4).alias("source_state"),
        (i % 7 != 0).alias("has_text"), (i % 5 == 0).alias("visual_needed"), _pick(("PRESENT", "MISSING", "UNRELIABLE"), F.floor(i / 5) % 3).alias("visual_state"), (i % 2 == 0).alias("connection_relevant"),
        F.when(i % 4 == 0, F.concat(F.lit("t"), (i % 9).cast("string"))).alias("template"), F.when(i % 3 > 0, F.concat(F.lit("q"), (i % 2).cast("string"))).alias("question_intent"),
    )


MISSIONS = f"""missions AS (SELECT mission_id, concept, CASE WHEN mission_id % 10 = 0 THEN ['PLANNED','PAUSED','COMPLETED','STOPPED'][mission_id // 10 % 4 + 1] ELSE 'ACTIVE' END AS status,
  ['UNDERSTANDING','RETRIEVAL','CONNECTION','APPLICATION','PREREQUISITE_SUPPORT','FEEDBACK','REFLECTION','EVIDENCE_UPDATE'][mission_id % 8 + 1] AS stage, 30 + mission_id % 40 AS available_minutes, mission_id % 45 AS spent,
  ['STRICT_SOURCE','SOURCE_FIRST','GENERAL_KNOWLEDGE'][mission_id % 3 + 1] AS grounding, ['READY','READY','LIMITED','ABSENT'][mission_id // 3 % 4 + 1] AS source_state, mission_id % 7 <> 0 AS has_text, mission_id % 5 = 0 AS visual_needed,
  ['PRESENT','MISSING','UNRELIABLE'][mission_id // 5 % 3 + 1] AS visual_state, mission_id % 2 = 0 AS connection_relevant, CASE WHEN mission_id % 4 = 0 THEN 't' || (mission_id % 9) END AS template, CASE WHEN mission_id % 3 > 0 THEN 'q' || (mission_id % 2) END AS question_intent FROM (SELECT mission_id, arg_max(concept, sequence) AS concept FROM k_attempts GROUP BY 1))"""
SNAPSHOT = """ev AS (SELECT event_id, mission_id, concept, CASE activity WHEN 'UNDERSTAND' THEN 'UNDERSTANDING' WHEN 'RETRIEVE' THEN 'RECALL' WHEN 'CONNECT' THEN 'CONNECTION' ELSE 'APPLICATION' END AS dimension, CASE outcome WHEN 'CORRECT' THEN 'DEVELOPING' WHEN 'PARTIAL' THEN 'WEAK' ELSE 'INSUFFICIENT' END AS strength FROM k_attempts WHERE outcome IS NOT NULL),
 snap AS (SELECT mission_id, concept, coalesce(max(r) FILTER (dimension = 'UNDERSTANDING'), 0) AS understanding, coalesce(max(r) FILTER (dimension = 'RECALL'), 0) AS recall, coalesce(max(r) FILTER (dimension = 'CONNECTION'), 0) AS connection, coalesce(max(r) FILTER (dimension = 'APPLICATION'), 0) AS application
  FROM (SELECT *, CASE strength WHEN 'DEVELOPING' THEN 2 WHEN 'WEAK' THEN 1 ELSE 0 END::BIGINT AS r FROM ev) GROUP BY 1, 2)"""


def _streak(name: str, cond: str = "true") -> str:
    return f"""{name}_k AS (SELECT * FROM k_attempts WHERE outcome IS NOT NULL AND {cond}), {name}_l AS (SELECT mission_id, concept, max(sequence) FILTER (outcome = 'CORRECT') AS last FROM {name}_k GROUP BY 1, 2),
 {name} AS (SELECT l.mission_id, l.concept, count(k.event_id) AS failures, arg_max(k.difficulty, k.sequence) AS failed_difficulty FROM {name}_l l LEFT JOIN {name}_k k ON k.mission_id = l.mission_id AND k.concept = l.concept AND (last IS NULL OR k.sequence > last) GROUP BY 1, 2)"""


STATES = f"""WITH {MISSIONS}, {SNAPSHOT}, {_streak('streak')}, {_streak('ap', "activity = 'APPLY'")},
 aged AS (SELECT *, row_number() OVER (PARTITION BY mission_id, concept ORDER BY sequence DESC) AS age FROM k_attempts),
 rec AS (SELECT mission_id, concept, max(activity) FILTER (age = 1) AS n_act, max(outcome) FILTER (age = 1) AS n_out, list(activity || ':' || difficulty || ':' || question_intent) AS recent, list(template) AS templates FROM aged WHERE age <= 3 GROUP BY 1, 2),
 st AS (SELECT m.*, coalesce(understanding, 0) AS u, coalesce(recall, 0) AS r, coalesce(connection, 0) AS c, coalesce(application, 0) AS a, n_act, n_out, recent, templates, coalesce(s.failures, 0) AS failures, s.failed_difficulty, coalesce(p.failures, 0) AS apf, p.failed_difficulty AS apd, greatest(0, available_minutes - spent) AS minutes_left
  FROM missions m LEFT JOIN snap USING (mission_id, concept) LEFT JOIN rec USING (mission_id, concept) LEFT JOIN streak s USING (mission_id, concept) LEFT JOIN ap p USING (mission_id, concept)),
 s2 AS (SELECT *, CASE WHEN u < 2 AND n_act = 'UNDERSTAND' AND n_out IS NULL THEN 'UNDERSTANDING_CHECK|FOUNDATIONAL|UNDERSTANDING_UNCHECKED|STANDARD' WHEN u < 2 THEN 'UNDERSTAND|FOUNDATIONAL|FOUNDATION_INSUFFICIENT|STANDARD'
   WHEN r < 2 AND n_act = 'RETRIEVE' AND n_out IN ('PARTIAL','INCORRECT') THEN 'UNDERSTAND|FOUNDATIONAL|RETRIEVAL_GAP|REASSESSMENT' WHEN r < 2 THEN 'RETRIEVE|FOUNDATIONAL|RETRIEVAL_READY|STANDARD'
   WHEN stage IN ('UNDERSTANDING','RETRIEVAL','CONNECTION','APPLICATION') THEN CASE WHEN connection_relevant AND c < 2 THEN 'CONNECT|INTERMEDIATE|' || CASE c WHEN 1 THEN 'CONNECTION_GAP' ELSE 'CONNECTION_READY' END || '|STANDARD' WHEN a = 3 THEN 'FEEDBACK||APPLICATION_STRONG|STANDARD'
     WHEN apf >= 2 THEN 'REDUCE_DIFFICULTY|' || CASE apd WHEN 'APPLIED' THEN 'INTERMEDIATE' ELSE 'FOUNDATIONAL' END || '|APPLICATION_GAP|STANDARD' ELSE 'APPLY|' || coalesce(apd, 'FOUNDATIONAL') || '|APPLICATION_READY|STANDARD' END
   WHEN stage = 'PREREQUISITE_SUPPORT' THEN 'UNDERSTAND|FOUNDATIONAL|PREREQUISITE|STANDARD' WHEN stage = 'FEEDBACK' THEN 'FEEDBACK||STAGE|STANDARD' WHEN stage = 'REFLECTION' THEN 'REFLECT||STAGE|STANDARD' ELSE 'COMPLETE||STAGE|STANDARD' END AS x FROM st),
 s3 AS (SELECT * REPLACE (CASE WHEN (x LIKE 'APPLY|%' OR stage <> 'APPLICATION') AND n_act IS NOT NULL AND n_out IS DISTINCT FROM 'CORRECT' AND failures >= 1 THEN
   CASE WHEN failures >= 5 THEN 'RETRY' WHEN failures = 4 THEN 'PREREQUISITE_SUPPORT' WHEN failures = 3 THEN 'UNDERSTAND' WHEN failures = 2 THEN 'HINT' ELSE 'RETRY' END || '|' || failed_difficulty || '|CORRECTIVE|CORRECTIVE_RETRY' ELSE x END AS x) FROM s2),
 s4 AS (SELECT * REPLACE (CASE WHEN why IS NULL THEN x WHEN why = 'SOURCE_LIMITED' THEN split_part(x, '|', 1) || '|' || split_part(x, '|', 2) || '|SOURCE_LIMITED|' || split_part(x, '|', 4) WHEN grounding <> 'STRICT_SOURCE' THEN 'UNDERSTAND|FOUNDATIONAL|' || why || '|STANDARD' ELSE 'COMMUNICATE_LIMITATION||' || why || '|STANDARD' END AS x) FROM (SELECT *,
   CASE WHEN visual_needed AND visual_state = 'MISSING' THEN 'VISUAL_UNAVAILABLE' WHEN visual_needed AND visual_state = 'UNRELIABLE' THEN 'VISUAL_UNRELIABLE' WHEN grounding = 'GENERAL_KNOWLEDGE' OR (source_state = 'READY' AND has_text) THEN NULL WHEN source_state = 'LIMITED' AND has_text THEN 'SOURCE_LIMITED' ELSE 'SOURCE_UNAVAILABLE' END AS why FROM s3)),
 s5 AS (SELECT * REPLACE (CASE WHEN act IN ('COMPLETE','COMMUNICATE_LIMITATION') OR CASE act WHEN 'UNDERSTAND' THEN 8 WHEN 'RETRIEVE' THEN 4 WHEN 'CONNECT' THEN 8 WHEN 'APPLY' THEN 16 ELSE 2 END <= minutes_left THEN x
   WHEN act IN ('UNDERSTAND','CONNECT','APPLY') AND u >= 2 AND minutes_left >= 4 THEN 'RETRIEVE|FOUNDATIONAL|TIME_LIMIT|STANDARD' WHEN minutes_left >= 2 THEN 'REFLECT||TIME_LIMIT|STANDARD' ELSE 'COMPLETE||TIME_LIMIT|STANDARD' END AS x) FROM (SELECT *, split_part(x, '|', 1) AS act FROM s4)),
 s6 AS (SELECT *, CASE status WHEN 'PLANNED' THEN 'START||LIFECYCLE|STANDARD' WHEN 'PAUSED' THEN 'RESUME||LIFECYCLE|STANDARD' WHEN 'COMPLETED' THEN 'COMPLETE||LIFECYCLE|STANDARD' WHEN 'STOPPED' THEN 'STOP||LIFECYCLE|STANDARD' ELSE
   CASE WHEN split_part(x, '|', 1) NOT IN ('FEEDBACK','REFLECT','COMPLETE') AND split_part(x, '|', 3) NOT IN ('SOURCE_LIMITED','SOURCE_UNAVAILABLE','VISUAL_UNAVAILABLE','VISUAL_UNRELIABLE','TIME_LIMIT') AND split_part(x, '|', 4) = 'STANDARD'
     AND (coalesce(list_contains(templates, template), false) OR coalesce(list_contains(recent, split_part(x, '|', 1) || ':' || split_part(x, '|', 2) || ':' || question_intent), false)) THEN 'REFLECT||REPETITION|STANDARD' ELSE x END END AS y FROM s5)"""
ACTIONS = STATES + ", actions AS (SELECT mission_id, stage, split_part(y, '|', 1) AS action, nullif(split_part(y, '|', 2), '') AS difficulty, split_part(y, '|', 3) AS rationale, split_part(y, '|', 4) AS intent FROM s6)"


def states(spark, sf):
    return ln.assemble_states(c.k_attempts(spark, sf), _missions(spark, sf), NOW)


def actions(spark, sf):
    return ln.next_actions(states(spark, sf))


def _failures(spark, sf):
    m = _missions(spark, sf)
    return m.select("mission_id", _pick(("RAG_LIMITED", "RAG_INSUFFICIENT", "RAG_FAILED", "AI_UNAVAILABLE", "AI_EVALUATION_FAILED"), F.col("mission_id") % 5).alias("failure"), "grounding", "has_text", "status", "source_state", "visual_needed", "visual_state", F.col("connection_relevant").alias("reusable"))


def _log(spark, sf):
    return c.k_attempts(spark, sf).select("mission_id", "event_id", "ts", _pick(("PLANNED", "ACTIVE", "PAUSED", "COMPLETED", "STOPPED"), F.col("event_id") % 5).alias("status"))


QUERIES = {
    "number_attempts": lambda s, d: ln.number_attempts(c.k_attempts(s, d)).select("event_id", "mission_id", "concept", "attempt_number"),
    "evidence_events": lambda s, d: ln.evidence_events(c.k_attempts(s, d)),
    "evidence_snapshot": lambda s, d: ln.evidence_snapshot(c.k_attempts(s, d)),
    "failure_streak": lambda s, d: ln.failure_streak(c.k_attempts(s, d)),
    "accidental_repeats": lambda s, d: ln.accidental_repeats(c.k_attempts(s, d)),
    "assemble_states": lambda s, d: states(s, d).select("mission_id", "concept", "understanding", "recall", "connection", "application", "failures", "apply_failures", "minutes_left"),
    "next_actions": actions,
    "next_stage": lambda s, d: ln.next_stage(actions(s, d).join(_missions(s, d).select("mission_id", "stage"), "mission_id")).select("mission_id", "action", "next_stage"),
    "failure_actions": lambda s, d: ln.failure_actions(_failures(s, d)),
    "illegal_transitions": lambda s, d: ln.illegal_transitions(_log(s, d)),
    "reusable_content": lambda s, d: ln.reusable_content(actions(s, d).join(_missions(s, d).select("mission_id", "template", "question_intent", "visual_needed"), "mission_id").select(F.col("mission_id").alias("request_id"), F.col("action").alias("activity"), "difficulty", "template", "question_intent", "visual_needed"), c.k_attempts(s, d).select(F.col("event_id").alias("artifact_id"), "activity", "difficulty", "template", "question_intent", "ts", F.coalesce(F.col("outcome") == "CORRECT", F.lit(False)).alias("validated"))),
    "grade_mcq": lambda s, d: ln.grade_mcq(c.table(s, d, "events").select("event_id", F.concat(F.lit(" "), F.upper("event_type")).alias("answer"), F.when(F.col("user_id") % 2 == 0, "click").otherwise("view").alias("correct"))).select("event_id", "outcome"),
}

A = "k_attempts"
ORACLE_SQL = {
    "number_attempts": c.sql(A, "SELECT event_id, mission_id, concept, row_number() OVER (PARTITION BY mission_id, concept ORDER BY ts, event_id) AS attempt_number FROM k_attempts"),
    "evidence_events": c.sql(A, f"WITH {SNAPSHOT} SELECT * FROM ev"),
    "evidence_snapshot": c.sql(A, f"WITH {SNAPSHOT} SELECT * FROM snap"),
    "failure_streak": c.sql(A, f"WITH {_streak('streak')} SELECT * FROM streak"),
    "accidental_repeats": c.sql(A, "SELECT event_id, mission_id, concept, activity, difficulty FROM k_attempts QUALIFY " + " OR ".join(f"coalesce(lag(template, {i}) OVER w = template, false) OR coalesce(lag(activity, {i}) OVER w = activity AND lag(difficulty, {i}) OVER w = difficulty AND lag(question_intent, {i}) OVER w = question_intent, false)" for i in (1, 2, 3))).replace("OVER w", "OVER (PARTITION BY mission_id, concept ORDER BY sequence)"),
    "assemble_states": c.sql(A, f"{STATES} SELECT mission_id, concept, u AS understanding, r AS recall, c AS connection, a AS application, failures, apf AS apply_failures, minutes_left FROM st"),
    "next_actions": c.sql(A, f"{ACTIONS} SELECT mission_id, action, difficulty, rationale, intent FROM actions"),
    "next_stage": c.sql(A, f"{ACTIONS} SELECT mission_id, action, CASE action WHEN 'UNDERSTAND' THEN 'UNDERSTANDING' WHEN 'UNDERSTANDING_CHECK' THEN 'UNDERSTANDING' WHEN 'RETRIEVE' THEN 'RETRIEVAL' WHEN 'CONNECT' THEN 'CONNECTION' WHEN 'APPLY' THEN 'APPLICATION' WHEN 'REDUCE_DIFFICULTY' THEN 'APPLICATION' WHEN 'PREREQUISITE_SUPPORT' THEN 'PREREQUISITE_SUPPORT' WHEN 'FEEDBACK' THEN 'FEEDBACK' WHEN 'REFLECT' THEN 'REFLECTION' WHEN 'COMPLETE' THEN 'EVIDENCE_UPDATE' ELSE stage END AS next_stage FROM actions"),
    "failure_actions": c.sql(A, f"WITH {MISSIONS}, own AS (SELECT *, CASE mission_id % 5 WHEN 0 THEN CASE WHEN has_text THEN 'SOURCE_ONLY' ELSE 'COMMUNICATE_LIMITATION' END WHEN 1 THEN CASE WHEN grounding <> 'STRICT_SOURCE' THEN 'UNDERSTAND' ELSE 'COMMUNICATE_LIMITATION' END WHEN 2 THEN CASE WHEN connection_relevant THEN 'REUSE_VALIDATED_CONTENT' ELSE 'RETRY_DEPENDENCY' END WHEN 3 THEN CASE WHEN connection_relevant THEN 'REUSE_VALIDATED_CONTENT' WHEN grounding <> 'GENERAL_KNOWLEDGE' AND has_text THEN 'SOURCE_ONLY' ELSE 'PAUSE' END ELSE 'RETRY_DEPENDENCY' END AS act FROM missions) SELECT mission_id, CASE status WHEN 'PLANNED' THEN 'START' WHEN 'PAUSED' THEN 'RESUME' WHEN 'COMPLETED' THEN 'COMPLETE' WHEN 'STOPPED' THEN 'STOP' ELSE CASE WHEN act IN ('PAUSE', 'REUSE_VALIDATED_CONTENT', 'UNDERSTAND') THEN act WHEN (visual_needed AND visual_state IN ('MISSING', 'UNRELIABLE')) OR (grounding <> 'GENERAL_KNOWLEDGE' AND NOT (source_state IN ('READY', 'LIMITED') AND has_text)) THEN CASE WHEN grounding <> 'STRICT_SOURCE' THEN 'UNDERSTAND' ELSE 'COMMUNICATE_LIMITATION' END ELSE act END END AS action FROM own"),
    "illegal_transitions": c.sql(A, "WITH l AS (SELECT mission_id, event_id, status, lag(status) OVER (PARTITION BY mission_id ORDER BY ts, event_id) AS before FROM (SELECT *, ['PLANNED','ACTIVE','PAUSED','COMPLETED','STOPPED'][event_id % 5 + 1] AS status FROM k_attempts)) SELECT mission_id, event_id, before, status FROM l WHERE before <> status AND (before || '>' || status) NOT IN ('PLANNED>ACTIVE','ACTIVE>PAUSED','ACTIVE>COMPLETED','ACTIVE>STOPPED','PAUSED>ACTIVE','PAUSED>STOPPED')"),
    "reusable_content": c.sql(A, f"{ACTIONS}, best AS (SELECT activity, difficulty, question_intent, template, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS artifact_id FROM k_attempts WHERE outcome = 'CORRECT' GROUP BY 1, 2, 3, 4) SELECT a.mission_id AS request_id, artifact_id FROM actions a JOIN missions m USING (mission_id) JOIN best b ON b.activity = a.action AND b.difficulty IS NOT DISTINCT FROM a.difficulty AND b.question_intent IS NOT DISTINCT FROM m.question_intent AND b.template IS NOT DISTINCT FROM m.template WHERE NOT m.visual_needed"),
    "grade_mcq": "SELECT event_id, CASE WHEN event_type = CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END THEN 'CORRECT' ELSE 'INCORRECT' END AS outcome FROM events",
}
