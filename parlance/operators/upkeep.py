"""Keeping the record: who the operator is, what a meeting teaches, and what a change of mind or model undoes.

Parquet has no merge, so each step takes tables and returns the new ones; the caller writes them as the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import intervals, matching, registry

#: The operator's least time on the microphone, share and lead of it, what a new voice must have said, and what may enrol.
LEAST_OPERATOR_MS, DOMINANCE, DOMINANCE_MARGIN, LEAST_SPEAKER_MS = 20_000, 0.80, 0.5, 10_000


def dominates(leader: Column, second: Column, total: Column, share: float = DOMINANCE, margin: float = DOMINANCE_MARGIN, least_ms: int = LEAST_OPERATOR_MS) -> Column:
    """Whether the leader's time is enough, a large enough share, and far enough ahead; second is null if there is none."""
    return (leader >= least_ms) & (leader / total >= share) & (second.isNull() | ((leader - second) / total > margin))


def dominant(turns: DataFrame, share: float = DOMINANCE, margin: float = DOMINANCE_MARGIN, least_ms: int = LEAST_OPERATOR_MS) -> DataFrame:
    """(meeting, cluster) that has most of the microphone's time, by enough."""
    time = turns.where("channel = 'mic'").groupBy("meeting", "cluster").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    whole = Window.partitionBy("meeting")
    order = whole.orderBy(F.col("ms").desc(), "cluster")
    rows = time.select("*", F.row_number().over(order).alias("place"), F.lead("ms").over(order).alias("second"), F.sum("ms").over(whole).alias("total"))
    return rows.where((F.col("place") == 1) & dominates(F.col("ms"), F.col("second"), F.col("total"), share, margin, least_ms)).select("meeting", "cluster")


def operator_cluster(turns: DataFrame, facts: DataFrame, matches: DataFrame, **limits: float) -> DataFrame:
    """(meeting, how, cluster) of facts (meeting, mic_isolated, enrolled) and matches (meeting, cluster) of the operator's print.

    An enrolled print decides alone. Else a lone voice on an isolated microphone, a dominant one, or a match of the
    learned print, which counts only in meetings with 30 seconds and two voices.
    """
    mic = turns.where("channel = 'mic'").groupBy("meeting").agg(F.collect_set("cluster").alias("voices")).where(F.size("voices") == 1).select("meeting", F.col("voices")[0].alias("lone"))
    gate = turns.groupBy("meeting").agg(((F.sum(F.col("end_ms") - F.col("start_ms")) >= 30_000) & (F.countDistinct("cluster") >= 2)).alias("gate"))
    speaks = turns.where("channel = 'mic'").select("meeting", "cluster").distinct()
    match = matches.join(speaks, ["meeting", "cluster"], "left_semi").groupBy("meeting").agg(F.min("cluster").alias("matched"))
    rows = facts.join(mic, "meeting", "left").join(dominant(turns, **limits).withColumnRenamed("cluster", "leader"), "meeting", "left").join(match, "meeting", "left").join(gate, "meeting", "left")
    none = F.lit(None)
    enrolled = F.when(F.col("enrolled"), F.struct(F.when(F.col("matched").isNotNull(), "enrolled").otherwise("nobody").alias("how"), F.col("matched").alias("cluster")))
    lone = F.when(F.col("mic_isolated") & F.col("lone").isNotNull(), F.struct(F.lit("isolated").alias("how"), F.col("lone").alias("cluster")))
    leader = F.when(F.col("leader").isNotNull(), F.struct(F.lit("dominant").alias("how"), F.col("leader").alias("cluster")))
    known = F.when(F.col("matched").isNotNull() & F.col("gate"), F.struct(F.lit("recognised").alias("how"), F.col("matched").alias("cluster")))
    nobody = F.struct(F.lit("nobody").alias("how"), none.cast("string").alias("cluster"))
    return rows.select("meeting", F.coalesce(enrolled, lone, leader, known, nobody).alias("o")).select("meeting", "o.how", "o.cluster")


def assigned(clusters: DataFrame, heard: DataFrame, seeds: DataFrame, claims: DataFrame, floor: float = matching.MATCH_FLOOR, margin: float = matching.MATCH_MARGIN) -> DataFrame:
    """(meeting, cluster, speaker_id, minted) of heard clusters (with voiced_ms): claimed, else matched, else new if long enough.

    claims: (meeting, cluster, speaker_id) from unanimous corrections; claimed clusters don't compete in the match.
    """
    open_ones = clusters.join(claims, ["meeting", "cluster"], "left_anti")
    found = matching.resolved(matching.scored(open_ones, seeds), floor, margin).select("meeting", "cluster", F.col("speaker_id").alias("matched"))
    free = open_ones.join(heard, ["meeting", "cluster"], "left_semi").join(found, ["meeting", "cluster"], "left")
    fresh = free.where(F.col("matched").isNotNull() | (F.col("voiced_ms") >= LEAST_SPEAKER_MS)).select("meeting", "cluster", F.col("matched").alias("speaker_id"), F.col("matched").isNull().alias("minted"))
    return fresh.unionByName(claims.join(heard, ["meeting", "cluster"], "left_semi").select("meeting", "cluster", "speaker_id", F.lit(False).alias("minted")))


def voiceprints(exemplars: DataFrame) -> DataFrame:
    """(speaker_id, model, model_version, vector, n): the newest exemplar fixes the space, then cap and mean."""
    space = exemplars.groupBy("speaker_id").agg(F.max_by(F.struct("model", "model_version"), "id").alias("s"))
    mine = exemplars.join(space.select("speaker_id", "s.model", "s.model_version"), ["speaker_id", "model", "model_version"])
    kept = matching.capped(mine.where("not is_negative"))
    return matching.centroids(kept, "speaker_id", "model", "model_version")


def relearning(segments: DataFrame, hints: DataFrame, eligible: DataFrame) -> DataFrame:
    """C17: (meeting, sequence, speaker_id, is_negative): what each segment says for and against eligible speakers.

    The newest hint decides; microphone segments that a far-end one overlaps prove nothing; whom the hint replaced
    is denied, overlapped or not. hints have replaced_id.
    """
    real = segments.where("end_ms > start_ms").withColumn("id", F.concat_ws("-", "meeting", "sequence"))
    newest = hints.groupBy("meeting", "sequence").agg(F.max_by(F.struct("speaker_id", "replaced_id"), F.struct("created_at", "id")).alias("h"))
    rows = real.join(newest, ["meeting", "sequence"], "left").withColumn("owner", F.when(F.col("h").isNotNull(), F.col("h.speaker_id")).otherwise(F.col("speaker_id")))
    mic, far = rows.where("channel = 'mic'"), rows.where("channel = 'system'")
    clear = intervals.clear_of(mic, far, "meeting").unionByName(far)
    able = eligible.select(F.col("id").alias("able"))
    yes = clear.join(able, F.col("owner") == F.col("able"), "left_semi").select("meeting", "sequence", F.col("owner").alias("speaker_id"), F.lit(False).alias("is_negative"))
    denied = rows.where(F.col("h.replaced_id").isNotNull() & ~F.col("h.replaced_id").eqNullSafe(F.col("owner")))
    no = denied.join(able, F.col("h.replaced_id") == F.col("able"), "left_semi").select("meeting", "sequence", F.col("h.replaced_id").alias("speaker_id"), F.lit(True).alias("is_negative"))
    return yes.unionByName(no)


def relearning_owners(plan: DataFrame, exemplars: DataFrame, eligible: DataFrame) -> DataFrame:
    """U4: (meeting, speaker_id) whose exemplars a relearning replaces: those of the plan, and eligible ones that hold some of the meeting now."""
    held = exemplars.where("meeting is not null").select("meeting", "speaker_id").join(eligible.select(F.col("id").alias("speaker_id")), "speaker_id", "left_semi")
    return plan.select("meeting", "speaker_id").union(held.select("meeting", "speaker_id")).distinct()


def claims(assignments: DataFrame, eligible: DataFrame) -> DataFrame:
    """(meeting, cluster, claimed, denied): the speaker that all segments of a cluster name, and the one that all were taken from.

    assignments: (meeting, cluster, owner, replaced), a row a segment; those without a cluster say nothing. Whoever isn't
    eligible counts as nobody, which breaks unanimity. Nobody is denied what they claim. Clusters with neither have no row.
    """
    able = lambda c: eligible.select(F.col("id").alias(c), F.col("id").alias(f"able_{c}"))
    rows = assignments.where("cluster is not null").join(able("owner"), "owner", "left").join(able("replaced"), "replaced", "left")
    agreed = lambda c: F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))
    found = rows.groupBy("meeting", "cluster").agg(agreed("able_owner").alias("claimed"), agreed("able_replaced").alias("denied"))
    return found.withColumn("denied", F.when(~F.col("denied").eqNullSafe(F.col("claimed")), F.col("denied"))).where("claimed is not null or denied is not null")


def digest_id(*parts: str | Column) -> Column:
    """A positive long from what a row stands for."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])), 1, 15), 16, 10).cast("long")


def corrected(segments: DataFrame, exemplars: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What corrections (meeting, sequence, speaker_id) add: hints with replaced_id, and exemplars.

    The meeting's positive exemplars of the wrong speaker are given to the right one, and again to the wrong one as
    negatives; both are the operator's word, with ids of their own, made of the segment, the original's id (copy_of) and the sign. Where the
    segment named nobody, or the same speaker, only the hint is added.
    """
    before = segments.select("meeting", "sequence", F.col("speaker_id").alias("replaced_id"))
    hints = corrections.select("meeting", "sequence", "speaker_id").join(before, ["meeting", "sequence"], "left")
    moved = hints.where("replaced_id <> speaker_id").select("meeting", "sequence", F.col("speaker_id").alias("right_id"), F.col("replaced_id").alias("speaker_id"))
    base = exemplars.where(~F.col("is_negative")).join(moved, ["meeting", "speaker_id"])
    two = F.array(F.struct(F.col("right_id").alias("speaker_id"), F.lit(False).alias("is_negative")), F.struct("speaker_id", F.lit(True).alias("is_negative")))
    copies = base.withColumn("__new", F.explode(two))
    new = {"speaker_id": F.col("__new.speaker_id"), "is_negative": F.col("__new.is_negative"), "copy_of": F.col("id"), "source": F.lit("operator"), "id": digest_id("meeting", "sequence", "id", F.col("__new.is_negative").cast("string"))}
    return hints, copies.withColumns(new).drop("__new", "right_id")


#: Columns of a meeting that its document shows. The name of the written file is not one, or writing would never end.
SHOWN = ("title", "started_at", "ended_at", "detected_app", "audio_path")


def changed(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = SHOWN, key: str = "id") -> DataFrame:
    """Q1: (meeting): rows that are new, or that differ in one of the columns."""
    old = before.select(key, F.struct(*columns).alias("__old"))
    return after.select(key, F.struct(*columns).alias("__new")).join(old, key, "left").where(F.col("__old").isNull() | ~F.col("__old").eqNullSafe(F.col("__new"))).select(F.col(key).alias("meeting"))


def marked(dirty: DataFrame, touched: DataFrame) -> DataFrame:
    """Q1: dirty (meeting, generation, acknowledged) after changes: touched has a row (meeting) a change, each a generation more."""
    more = touched.groupBy("meeting").agg(F.count(F.lit(1)).alias("more"))
    known = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return dirty.join(more, "meeting", "full").select("meeting", (known("generation") + known("more")).alias("generation"), known("acknowledged").alias("acknowledged"))


def unchanged(plan: DataFrame, now: DataFrame) -> bool:
    """C17: whether a plan still is what it would be if it were made now."""
    return plan.exceptAll(now).isEmpty() and now.exceptAll(plan).isEmpty()


def adopted(exemplars: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Exemplars with the vectors of rebuilt (id, vector, model, model_version); those rebuilt without a vector go."""
    new = rebuilt.select("id", F.lit(True).alias("made"), F.col("vector").alias("v"), F.col("model").alias("m"), F.col("model_version").alias("mv"))
    rows = exemplars.join(new, "id", "left").where("made is null or v is not null")
    return rows.select(*[F.coalesce(n, c).alias(c) if n else F.col(c) for c in exemplars.columns for n in [{"vector": "v", "model": "m", "model_version": "mv"}.get(c)]])


def forgotten(speakers: DataFrame, exemplars: DataFrame, speaker_id: int) -> tuple[DataFrame, DataFrame]:
    """A voice deleted: the speaker stays, marked; the exemplars go."""
    return speakers.withColumn("forgotten", F.col("forgotten") | (F.col("id") == speaker_id)), exemplars.where(~F.col("speaker_id").eqNullSafe(F.lit(speaker_id)))


def enrolment(turns: DataFrame, peaks: DataFrame) -> DataFrame:
    """(meeting, verdict): a recording enrols if it has sound, one voice and 20 seconds of speech. peaks: (meeting, peak)."""
    said = turns.groupBy("meeting").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.countDistinct("cluster").alias("voices"))
    rows = peaks.join(said, "meeting", "left")
    verdict = F.when(F.col("peak") == 0, "silent").when(F.col("voices") > 1, "several-voices").when(F.coalesce("ms", F.lit(0)) < LEAST_OPERATOR_MS, "too-little").otherwise("accepted")
    return rows.select("meeting", verdict.alias("verdict"))


def interrupted_end(started: Column, last_write: Column, audio_seconds: Column) -> Column:
    """M3: the later of start plus audio and the last write; what there is of them, the start at least. Instants in seconds."""
    return F.greatest(F.coalesce(started + audio_seconds, last_write, started), F.coalesce(last_write, started))


def leg_state(channel: Column, ms: Column, peak: Column, heard_playback: Column) -> Column:
    """What a channel's test showed."""
    return F.when(peak > 0, "working").when((channel == "system") & heard_playback.eqNullSafe(F.lit(False)), "not-tested").when(ms == 0, "nothing-captured").otherwise("silent")


def leg_verdict(state: Column) -> Column:
    """Of the two channels together; an aggregate."""
    working, untested = F.count_if(state == "working"), F.count_if(state == "not-tested")
    return F.when(working == 2, "both-work").when((working == 1) & (untested == 1), "microphone-works").when(working == 1, "one-works").when(untested == 0, "nothing-captured").otherwise("nothing-tested")


def silent_leg_is_dead(channel: Column, ticks_with_playback: Column) -> Column:
    """After one grace period a silent microphone is dead, the other only if playback was heard twice."""
    return (channel == "mic") | (ticks_with_playback >= 2)


#: Processes that are known by their whole name or its beginning, and the apps they belong to.
HELPER_EXCEPTIONS = {
    "us.zoom.ZoomHybridConf": "us.zoom.xos",
    "us.zoom.ZoomClips": "us.zoom.xos",
    "com.microsoft.teams2.helper": "com.microsoft.teams2",
    "com.microsoft.teams2.modulehost": "com.microsoft.teams2",
}
PROCESS_PREFIXES = {"com.apple.WebKit": "com.apple.Safari"}
EXECUTABLES = {
    "zoom.exe": "us.zoom.xos",
    "ms-teams.exe": "com.microsoft.teams2",
    "teams.exe": "com.microsoft.teams2",
    "wemeetapp.exe": "com.tencent.tencentmeeting",
    "voovmeetingapp.exe": "com.tencent.tencentmeeting",
}
BROWSER_MEETINGS = "browser-meetings"


def folded(name: Column) -> Column:
    """A to Z in lower case, as names of apps are compared."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def watched(apps: DataFrame, watchlist: DataFrame, blocklist: DataFrame, browsers: DataFrame, app: str = "app") -> DataFrame:
    """Apps that watchlist (app, kind) names, or that are browsers if it has browser meetings; not those of blocklist (app)."""
    named = watchlist.where(F.col("kind") != BROWSER_MEETINGS).select(folded(F.col("app")).alias("w"))
    wanted = browsers.join(watchlist.where(F.col("kind") == BROWSER_MEETINGS).select("kind").distinct(), F.lit(True), "left_semi").select(folded(F.col("app")).alias("w"))
    blocked = blocklist.select(folded(F.col("app")).alias("b"))
    return apps.join(blocked, folded(F.col(app)) == F.col("b"), "left_anti").join(named.union(wanted), folded(F.col(app)) == F.col("w"), "left_semi")


def suggestions(suggested: DataFrame, watchlist: DataFrame) -> DataFrame:
    """The suggested (app, kind) that aren't on the watchlist."""
    return suggested.join(watchlist.select(folded(F.col("app")).alias("w")), folded(F.col("app")) == F.col("w"), "left_anti")


def responsible_app(process: Column, exceptions: dict[str, str] = HELPER_EXCEPTIONS, prefixes: dict[str, str] = PROCESS_PREFIXES, executables: dict[str, str] = EXECUTABLES) -> Column:
    """An exception's app, that of a known beginning or executable, or the process up to its first .helper; letters' case aside."""
    name = folded(process)
    at = F.instr(name, ".helper")
    found = F.when(at > 0, F.substring(process, F.lit(1), at - 1)).otherwise(process)
    rules = [*[(name == folded(F.lit(p)), app) for p, app in exceptions.items()], *[(name.startswith(folded(F.lit(p))), app) for p, app in prefixes.items()], *[(name == folded(F.lit(p)), app) for p, app in executables.items()]]
    for fits, app in reversed(rules):
        found = F.when(fits, F.lit(app)).otherwise(found)
    return found


def enqueued(queue: DataFrame, requests: DataFrame) -> DataFrame:
    """Q5: the queue after requests (meeting, priority, enqueued_at): the lower number wins; a new request for the front moves a meeting up."""
    both = queue.withColumn("new", F.lit(0)).unionByName(requests.withColumn("new", F.lit(1)))
    front = F.max(F.when((F.col("new") == 1) & (F.col("priority") == 0), F.col("enqueued_at")))
    rows = both.groupBy("meeting").agg(F.min("priority").alias("priority"), front.alias("front"), F.min_by("enqueued_at", F.struct("new", "enqueued_at")).alias("first"))
    return rows.select("meeting", "priority", F.coalesce(F.when(F.col("priority") == 0, F.col("front")), "first").alias("enqueued_at"))


def acknowledged(dirty: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Q3: dirty (meeting, generation, acknowledged) after rebuilding (meeting, generation): only that generation is acknowledged."""
    done = rebuilt.select("meeting", F.col("generation").alias("built"))
    return dirty.join(done, "meeting", "left").select("meeting", "generation", F.greatest("acknowledged", F.coalesce("built", F.lit(0))).alias("acknowledged"))


def folded_operator(matches: DataFrame, speakers: DataFrame, operator_id: int) -> DataFrame:
    """(speaker_id, into): anonymous speakers whose voice is the operator's; a named one is never folded."""
    return matches.join(speakers.where(registry.anonymous()).select(F.col("id").alias("speaker_id")), "speaker_id", "left_semi").where(F.col("speaker_id") != operator_id).select("speaker_id", F.lit(operator_id).cast("long").alias("into"))
