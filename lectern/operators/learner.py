"""Learner state from attempt logs and the next action of every mission, by column rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of evidence (fixed values); what is missing counts 0.
RANK = {"INSUFFICIENT": 0, "WEAK": 1, "DEVELOPING": 2, "STRONG": 3}
#: The dimension that an activity gives evidence for, and the strength of an outcome (fixed values).
DIMENSION = {"UNDERSTAND": "UNDERSTANDING", "RETRIEVE": "RECALL", "CONNECT": "CONNECTION", "APPLY": "APPLICATION"}
STRENGTH = {"CORRECT": "DEVELOPING", "PARTIAL": "WEAK", "INCORRECT": "INSUFFICIENT"}
#: The stage that follows an action (fixed values).
STAGE_OF = {"UNDERSTAND": "UNDERSTANDING", "UNDERSTANDING_CHECK": "UNDERSTANDING", "RETRIEVE": "RETRIEVAL", "CONNECT": "CONNECTION", "APPLY": "APPLICATION", "REDUCE_DIFFICULTY": "APPLICATION", "PREREQUISITE_SUPPORT": "PREREQUISITE_SUPPORT", "FEEDBACK": "FEEDBACK", "REFLECT": "REFLECTION", "COMPLETE": "EVIDENCE_UPDATE"}
#: Allowed changes of a mission's status (fixed values).
ALLOWED = (("PLANNED", "ACTIVE"), ("ACTIVE", "PAUSED"), ("ACTIVE", "COMPLETED"), ("ACTIVE", "STOPPED"), ("PAUSED", "ACTIVE"), ("PAUSED", "STOPPED"))


@dataclass(frozen=True)
class PolicyConfiguration:
    """Thresholds of the rules; minutes an action takes by default and by name."""

    hint_after: int = 2
    simplify_after: int = 3
    prerequisite_after: int = 4
    reattempt_after: int = 5
    reduce_after: int = 2
    repeat_window: int = 3
    default_minutes: int = 2
    minutes: dict = field(default_factory=lambda: {"UNDERSTAND": 8, "RETRIEVE": 4, "CONNECT": 8, "APPLY": 16})

    def __post_init__(self):
        ladder = (1, self.hint_after, self.simplify_after, self.prerequisite_after, self.reattempt_after)
        if any(b <= a for a, b in zip(ladder, ladder[1:])) or self.repeat_window < 1 or self.default_minutes < 1 or any(m < 1 for m in self.minutes.values()):
            raise ValueError("thresholds must rise, windows and minutes be positive")


def _lookup(key: Column, table: dict[str, object], default: Column | None = None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default) if default is not None else out


def number_attempts(attempts: DataFrame) -> DataFrame:
    """Adds attempt_number: the place among the attempts of the mission's concept, by time."""
    w = Window.partitionBy("mission_id", "concept").orderBy("ts", "event_id")
    return attempts.withColumn("attempt_number", F.row_number().over(w).cast("long"))


def evidence_events(attempts: DataFrame) -> DataFrame:
    """(event_id, mission_id, concept, dimension, strength) of attempts with an outcome; an unknown outcome counts as INCORRECT."""
    known = attempts.where("outcome is not null")
    return known.select("event_id", "mission_id", "concept", _lookup(F.col("activity"), DIMENSION).alias("dimension"), _lookup(F.col("outcome"), STRENGTH, F.lit("INSUFFICIENT")).alias("strength"))


def evidence_snapshot(attempts: DataFrame) -> DataFrame:
    """(mission_id, concept, understanding, recall, connection, application): the best rank of each."""
    e = evidence_events(attempts).withColumn("rank", _lookup(F.col("strength"), RANK))
    best = lambda d: F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("rank"))), F.lit(0)).cast("long").alias(d.lower())
    return e.groupBy("mission_id", "concept").agg(*map(best, DIMENSION.values()))


def failure_streak(attempts: DataFrame, only: str | None = None) -> DataFrame:
    """(mission_id, concept, failures, failed_difficulty): failures since the last CORRECT, and the newest one's difficulty."""
    known = attempts.where("outcome is not null")
    if only:
        known = known.where(F.col("activity") == only)
    last = known.where("outcome = 'CORRECT'").groupBy("mission_id", "concept").agg(F.max("sequence").alias("last"))
    after = known.join(last, ["mission_id", "concept"], "left").where("last is null or sequence > last")
    g = after.groupBy("mission_id", "concept").agg(F.count("*").alias("failures"), F.max_by("difficulty", "sequence").alias("failed_difficulty"))
    return known.select("mission_id", "concept").distinct().join(g, ["mission_id", "concept"], "left").select("mission_id", "concept", F.coalesce("failures", F.lit(0)).alias("failures"), "failed_difficulty")


def accidental_repeats(attempts: DataFrame, window: int = 3) -> DataFrame:
    """Attempts that repeat one of the ``window`` before, of the same concept.

    A repeat has the same template, or the same question intent, activity and
    difficulty; what has no template or intent repeats nothing by it.
    """
    w = Window.partitionBy("mission_id", "concept").orderBy("sequence")
    repeat = F.lit(False)
    for i in range(1, window + 1):
        same = lambda c: F.lag(c, i).over(w) == F.col(c)  # noqa: E731, B023
        repeat = repeat | F.coalesce(same("template"), F.lit(False)) | F.coalesce(same("question_intent") & same("activity") & same("difficulty"), F.lit(False))
    return attempts.withColumn("repeat", repeat).where("repeat").select("event_id", "mission_id", "concept", "activity", "difficulty")


def assemble_states(attempts: DataFrame, missions: DataFrame, now: str, window: int = 3) -> DataFrame:
    """The state of each mission: evidence and history of its current concept, and minutes left.

    ``missions``: (mission_id, status, stage, concept, available_minutes, started_at,
    grounding, source_state, has_text, visual_needed, visual_state, connection_relevant,
    template, question_intent).
    Newest is the highest sequence; a presentation without an outcome is history only.
    """
    key = ["mission_id", "concept"]
    w = Window.partitionBy(*key).orderBy(F.desc("sequence"))
    ranked = attempts.withColumn("age", F.row_number().over(w)).where(F.col("age") <= window)
    recent = ranked.groupBy(*key).agg(
        F.max(F.when(F.col("age") == 1, F.struct("activity", "outcome", "difficulty"))).alias("newest"),
        F.collect_set(F.struct("activity", "difficulty", F.col("template").alias("t"), F.col("question_intent").alias("q"))).alias("recent"),
    )
    streaks = failure_streak(attempts)
    applied = failure_streak(attempts, "APPLY").select(*key, F.col("failures").alias("apply_failures"), F.col("failed_difficulty").alias("apply_difficulty"))
    s = missions.join(evidence_snapshot(attempts), key, "left").join(recent, key, "left").join(streaks, key, "left").join(applied, key, "left")
    spent = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 60_000_000)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return s.withColumns({d: zero(F.col(d)) for d in ("understanding", "recall", "connection", "application", "failures", "apply_failures")} | {"minutes_left": F.greatest(F.lit(0), F.col("available_minutes") - spent).cast("long")})


def _action(action: str | Column, rationale: str | Column, difficulty: str | Column | None = None, intent: str = "STANDARD") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(as_col(action).alias("action"), as_col(difficulty).alias("difficulty"), as_col(rationale).alias("rationale"), F.lit(intent).alias("intent"))


_BASIC = "FOUNDATIONAL"


def _source_safe(a: Column) -> Column:
    """The action ``a``, or what takes its place if its source or visual isn't there."""
    outside = F.col("grounding") != "STRICT_SOURCE"
    alt = lambda why: F.when(outside, _action("UNDERSTAND", why, _BASIC)).otherwise(_action("COMMUNICATE_LIMITATION", why))
    needs = F.col("grounding").isin("STRICT_SOURCE", "SOURCE_FIRST")
    limited = F.struct(a["action"].alias("action"), a["difficulty"].alias("difficulty"), F.lit("SOURCE_LIMITED").alias("rationale"), a["intent"].alias("intent"))
    return (
        F.when(F.col("visual_needed") & (F.col("visual_state") == "MISSING"), alt("VISUAL_UNAVAILABLE"))
        .when(F.col("visual_needed") & (F.col("visual_state") == "UNRELIABLE"), alt("VISUAL_UNRELIABLE"))
        .when(~needs, a)
        .when((F.col("source_state") == "READY") & F.col("has_text"), a)
        .when((F.col("source_state") == "LIMITED") & F.col("has_text"), limited)
        .otherwise(alt("SOURCE_UNAVAILABLE"))
    )


def _lifecycle() -> Column:
    status = F.col("status")
    return F.when(status == "PLANNED", _action("START", "LIFECYCLE")).when(status == "PAUSED", _action("RESUME", "LIFECYCLE")).when(status == "COMPLETED", _action("COMPLETE", "LIFECYCLE")).when(status == "STOPPED", _action("STOP", "LIFECYCLE"))


def next_actions(states: DataFrame, config: PolicyConfiguration = PolicyConfiguration()) -> DataFrame:
    """(mission_id, action, difficulty, rationale, intent): lifecycle, progress, scaffold, source, time, repetition, in this order."""
    U, R, C, A = (F.col(x) for x in ("understanding", "recall", "connection", "application"))
    newest, stage = F.col("newest"), F.col("stage")
    failed = newest["outcome"].isin("PARTIAL", "INCORRECT")
    lifecycle = _lifecycle()
    shown = newest["activity"].isin("UNDERSTAND", "HINT", "PREREQUISITE_SUPPORT") & newest["outcome"].isNull()
    understand = _action("UNDERSTAND", "FOUNDATION_INSUFFICIENT", _BASIC)
    retrieve = _action("RETRIEVE", "RETRIEVAL_READY", F.when(R == 3, "INTERMEDIATE").otherwise(_BASIC))
    foundation = F.when((U < 2) & shown, _action("UNDERSTANDING_CHECK", "UNDERSTANDING_UNCHECKED", _BASIC)).when(U < 2, understand).when(failed & (newest["activity"] == "RETRIEVE"), _action("UNDERSTAND", "RETRIEVAL_GAP", _BASIC, "REASSESSMENT")).otherwise(retrieve)
    relevant = F.col("connection_relevant")
    connect = F.when(relevant & (C < 2), _action("CONNECT", F.when(C == 1, "CONNECTION_GAP").otherwise("CONNECTION_READY"), "INTERMEDIATE"))
    reduced = F.when(F.col("apply_difficulty") == "APPLIED", "INTERMEDIATE").otherwise(_BASIC)
    apply_ = F.when(A == 3, _action("FEEDBACK", "APPLICATION_STRONG")).when(F.col("apply_failures") >= config.reduce_after, _action("REDUCE_DIFFICULTY", "APPLICATION_GAP", reduced)).otherwise(_action("APPLY", "APPLICATION_READY", F.coalesce("apply_difficulty", F.lit(_BASIC))))
    progress = (
        F.when((U < 2) | (R < 2), foundation)
        .when(stage.isin("UNDERSTANDING", "RETRIEVAL", "CONNECTION", "APPLICATION"), F.coalesce(connect, apply_))
        .when(stage == "PREREQUISITE_SUPPORT", _action("UNDERSTAND", "PREREQUISITE", _BASIC))
        .when(stage == "FEEDBACK", _action("FEEDBACK", "STAGE"))
        .when(stage == "REFLECTION", _action("REFLECT", "STAGE"))
        .otherwise(_action("COMPLETE", "STAGE"))
    )
    n, level = F.col("failures"), F.col("failed_difficulty")
    fix = lambda a: _action(a, "CORRECTIVE", level, "CORRECTIVE_RETRY")
    ladder = F.when(n >= config.reattempt_after, fix("RETRY")).when(n >= config.prerequisite_after, fix("PREREQUISITE_SUPPORT")).when(n >= config.simplify_after, fix("UNDERSTAND")).when(n >= config.hint_after, fix("HINT")).when(n >= 1, fix("RETRY"))
    stepped = states.withColumn("a", progress)
    scaffold = ((F.col("a.action") == "APPLY") | (stage != "APPLICATION")) & newest.isNotNull() & ~newest["outcome"].eqNullSafe("CORRECT")
    stepped = stepped.withColumn("a", F.when(scaffold, F.coalesce(ladder, F.col("a"))).otherwise(F.col("a")))
    stepped = stepped.withColumn("a", _source_safe(F.col("a")))
    left = F.col("minutes_left")
    fits = lambda a: F.lit(config.minutes.get(a, config.default_minutes)) <= left
    cost = _lookup(F.col("a.action"), config.minutes, F.lit(config.default_minutes))
    free = F.col("a.action").isin("COMPLETE", "COMMUNICATE_LIMITATION", "SOURCE_ONLY", "REUSE_VALIDATED_CONTENT", "RETRY_DEPENDENCY", "PAUSE", "STOP")
    timed = F.when(free | (cost <= left), F.col("a")).when(F.col("a.action").isin("UNDERSTAND", "CONNECT", "APPLY") & (U >= 2) & fits("RETRIEVE"), _action("RETRIEVE", "TIME_LIMIT", _BASIC)).when(fits("REFLECT"), _action("REFLECT", "TIME_LIMIT")).otherwise(_action("COMPLETE", "TIME_LIMIT"))
    stepped = stepped.withColumn("a", timed)
    exempt = F.col("a.action").isin("FEEDBACK", "REFLECT", "COMPLETE") | F.col("a.rationale").isin("SOURCE_LIMITED", "SOURCE_UNAVAILABLE", "VISUAL_UNAVAILABLE", "VISUAL_UNRELIABLE", "TIME_LIMIT") | (F.col("a.intent") != "STANDARD")
    same = lambda x: (x["q"] == F.col("question_intent")) & (x["activity"] == F.col("a.action")) & (x["difficulty"] == F.col("a.difficulty"))
    seen = F.coalesce(F.exists("recent", lambda x: F.coalesce(x["t"] == F.col("template"), F.lit(False)) | F.coalesce(same(x), F.lit(False))), F.lit(False))
    stepped = stepped.withColumn("a", F.when(~exempt & seen, _action("REFLECT", "REPETITION")).otherwise(F.col("a")))
    return stepped.withColumn("a", F.coalesce(lifecycle, F.col("a"))).select("mission_id", "a.action", "a.difficulty", "a.rationale", "a.intent")


def failure_actions(failures: DataFrame) -> DataFrame:
    """(mission_id, action) after a dependency failure: lifecycle, the failure's own rule, then the source policy.

    ``failures``: (mission_id, status, failure, reusable) and what ``next_actions`` knows of the
    source. A pause, reused content and an alternative without a source depend on none.
    """
    outside, needs = F.col("grounding") != "STRICT_SOURCE", F.col("grounding").isin("STRICT_SOURCE", "SOURCE_FIRST")
    kind = F.col("failure")
    action = (
        F.when(kind == "RAG_LIMITED", F.when(F.col("has_text"), "SOURCE_ONLY").otherwise("COMMUNICATE_LIMITATION"))
        .when(kind == "RAG_INSUFFICIENT", F.when(outside, "UNDERSTAND").otherwise("COMMUNICATE_LIMITATION"))
        .when(kind == "RAG_FAILED", F.when(F.col("reusable"), "REUSE_VALIDATED_CONTENT").otherwise("RETRY_DEPENDENCY"))
        .when(kind == "AI_UNAVAILABLE", F.when(F.col("reusable"), "REUSE_VALIDATED_CONTENT").when(needs & F.col("has_text"), "SOURCE_ONLY").otherwise("PAUSE"))
        .when(kind == "AI_EVALUATION_FAILED", "RETRY_DEPENDENCY")
    )
    own = failures.withColumn("a", _action(action, "DEPENDENCY_FAILURE"))
    free = F.col("a.action").isin("PAUSE", "REUSE_VALIDATED_CONTENT", "UNDERSTAND")
    safe = F.when(free, F.col("a")).otherwise(_source_safe(F.col("a")))
    return own.select("mission_id", F.coalesce(_lifecycle(), safe)["action"].alias("action"))


def next_stage(actions: DataFrame, current: str = "stage") -> DataFrame:
    """Adds the stage that follows the action; other actions keep the stage."""
    return actions.withColumn("next_stage", _lookup(F.col("action"), STAGE_OF, F.col(current)))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """(mission_id, event_id, before, status) of changes that aren't allowed; staying in a status is no change."""
    w = Window.partitionBy("mission_id").orderBy("ts", "event_id")
    moved = log.withColumn("before", F.lag("status").over(w)).where("before is not null and before <> status")
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in ALLOWED])
    return moved.where(~F.array_contains(allowed, F.concat("before", F.lit(">"), "status"))).select("mission_id", "event_id", "before", "status")


def reusable_content(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(request_id, artifact_id): the newest validated artifact with the same type, difficulty, question intent and template (null equals null).

    A request that needs a visual reuses nothing.
    """
    same = ["activity", "difficulty", "question_intent", "template"]
    a = artifacts.where("validated").select("artifact_id", *[F.col(c).alias(f"__{c}") for c in same], "ts")
    best = a.groupBy(*[f"__{c}" for c in same]).agg(F.max_by("artifact_id", F.struct("ts", "artifact_id")).alias("artifact_id"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    return requests.where(~F.col("visual_needed")).join(best, on).select("request_id", "artifact_id")


def grade_mcq(answers: DataFrame) -> DataFrame:
    """Adds ``outcome``: the answer equals the correct option, whatever case and outer blanks."""
    same = F.lower(F.trim("answer")) == F.lower(F.trim("correct"))
    return answers.withColumn("outcome", F.when(F.coalesce(same, F.lit(False)), "CORRECT").otherwise("INCORRECT"))
