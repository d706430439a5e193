"""Evidence about what was on screen: tags, captions, aliases, chapters and summaries, and which of them may be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.time import DAY, HOUR, MINUTE, SECOND
from spanloom.operators.asof import nearest
from spanloom.operators.evidence import first_reason
from spanloom.operators.interval import point_join

SUPPORTED = ("model_inference", "featureprint_match")
# Fields of a status that may leave, and the shape of a code.
SAFE_FIELDS = (
    "status", "quality_status", "stop_reason", "capture_blocked_reason", "window_identity_status", "accessibility_access",
    "screen_capture_access", "trusted", "below_threshold", "selected", "completed", "failed", "sensitive_skipped",
    "elapsed_seconds", "errors", "dropped", "pending_after_run", "reader_exit_code",
)
SAFE_CODE = "^[a-zA-Z0-9_+-]{1,80}$"


# What a model's result may say.
KINDS = ("writing", "research", "communication", "coding", "administration", "learning", "media", "other", "unclear")
CLAIMS = ("activity_kind", "project_candidate", "task_candidate", "visible_work")
RESULT = (*("version",), *CLAIMS, "evidence_ids", "claim_evidence", "uncertainty")


def validate_results(records: DataFrame, evidence: DataFrame, version: str) -> DataFrame:
    """(id, code): the first rule that a model's JSON result breaks, or ok.

    records: id, record. evidence: id, evidence_id, primary (the current observation). Rules in order: malformed, keys (other
    fields than RESULT), version, kind, uncertainty, evidence (none cited, or one that was not supplied), text (a claim that is
    empty, over 240 characters, sensitive, has an address, or says that something is done; visible_work must be there),
    claims (other keys), citation (a claim cites what the result doesn't), null_claim (no claim, yet evidence), primary (a
    claim without the current observation), specific (unclear, yet a project or task). Ids are met one by one, so a result
    with very many is no long row anywhere.
    """
    schema = "version STRING, activity_kind STRING, project_candidate STRING, task_candidate STRING, visible_work STRING, evidence_ids ARRAY<STRING>, claim_evidence MAP<STRING, ARRAY<STRING>>, uncertainty STRING"
    told = records.select("id", F.from_json("record", schema).alias("r"), F.json_object_keys("record").alias("keys"))
    cited = told.select("id", F.explode("r.evidence_ids").alias("evidence_id")).distinct()
    unknown = cited.join(evidence.select("id", "evidence_id"), ["id", "evidence_id"], "left_anti").select("id").distinct().withColumn("__unknown", F.lit(True))
    main = evidence.where("primary").groupBy("id").agg(F.min("evidence_id").alias("__primary"))
    met = told.join(unknown, "id", "left").join(main, "id", "left")
    r = lambda c: F.col(f"r.{c}")
    of = lambda c: F.coalesce(F.element_at(r("claim_evidence"), c), F.array().cast("array<string>"))
    bad_text = lambda c: (T.squeezed(c) == "") | (F.length(c) > 240) | c.rlike(T.SENSITIVE) | c.rlike(T.EMAIL) | c.rlike(T.URL) | c.rlike(T.COMPLETION)
    either = lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs])
    rules = [
        ("malformed", F.col("keys").isNull()),
        ("keys", F.array_sort("keys") != F.array_sort(F.array(*[F.lit(c) for c in RESULT]))),
        ("version", ~r("version").eqNullSafe(F.lit(version))),
        ("kind", ~F.coalesce(r("activity_kind").isin(*KINDS), F.lit(False))),
        ("uncertainty", ~F.coalesce(r("uncertainty").isin("supported", "partial", "unclear"), F.lit(False))),
        ("evidence", (F.coalesce(F.size(r("evidence_ids")), F.lit(-1)) <= 0) | F.col("__unknown").isNotNull()),
        ("text", r("visible_work").isNull() | either([bad_text(r(c)) for c in CLAIMS[1:]])),
        ("claims", F.array_sort(F.map_keys(r("claim_evidence"))) != F.array_sort(F.array(*[F.lit(c) for c in CLAIMS]))),
        ("citation", either([F.size(F.array_except(of(c), r("evidence_ids"))) > 0 for c in CLAIMS])),
        ("null_claim", either([r(c).isNull() & (F.size(of(c)) > 0) for c in CLAIMS])),
        ("primary", either([r(c).isNotNull() & ~F.coalesce(F.array_contains(of(c), F.col("__primary")), F.lit(False)) for c in CLAIMS])),
        ("specific", (r("uncertainty") == "unclear") & (r("project_candidate").isNotNull() | r("task_candidate").isNotNull())),
    ]
    return met.select("id", first_reason(rules).alias("code"))


def batch_dispositions(asked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """What becomes of each row asked (key, id, source): (key, id, topic, status).

    answers: key, id, ord, topic, word. The first answer to an id counts; ids that were not asked count for nothing. A topic
    stands as model_inference if its text is fit, its evidence word occurs in the source and one of its subject words does;
    else the row is unclassified, and model_failed without any answer.
    """
    first = answers.groupBy(key, "id").agg(F.min_by(F.struct("topic", "word"), "ord").alias("a"))
    met = asked.join(first, [key, "id"], "left")
    source, word = F.lower("source"), F.trim(F.lower("a.word"))
    fit = (T.failure_code(F.col("a.topic"), 1, 65) == "ok") & (T.failure_code(F.col("a.word"), 1, 60) == "ok") & (F.lower("a.topic") != "unclear")
    backed = ((F.length(word) >= 4) | word.isin(*T.SHORT_SUBJECTS)) & F.contains(source, word) & F.arrays_overlap(T.subject_tokens(F.col("a.topic")), T.subject_tokens(F.col("source")))
    ok = F.coalesce(fit & backed, F.lit(False))
    status = F.when(F.col("a").isNull(), "model_failed").when(ok, "model_inference").otherwise("unclassified")
    return met.select(key, "id", F.when(ok, F.col("a.topic")).otherwise("Unclear").alias("topic"), status.alias("status"))


def slots(spans: DataFrame, step_us: int = 5 * SECOND) -> DataFrame:
    """Each span (start_us, end_us) once for each step of it, counted from its start: the step's length us and its mid."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end_us") - F.col("start_us") - 1) / step_us)))
    at = F.col("start_us") + F.col("k") * step_us
    told = spans.where("end_us > start_us").withColumn("k", k).withColumn("us", F.least(F.lit(step_us), F.col("end_us") - at))
    return told.withColumn("mid", at + F.floor(F.col("us") / 2)).drop("k")


def screen_suggested(segments: DataFrame, marks: DataFrame, keys: list[str], radius_us: int = 30 * SECOND) -> DataFrame:
    """Suggested time by keys and topic: what was visible around frames in segments whose window is unknown.

    segments: keys, start_us, end_us, app, sampled_us. marks: keys, mark_us, ord, topic, app. Each step of 5 s takes the
    nearest mark's topic, the first listed on a tie, if the apps agree where both are known; a segment's time counts by
    its sampled share. An estimate of what was visible, no claim of attention; no second counts twice.
    """
    own = [*keys, "start_us", "end_us", "app", "sampled_us"]
    told = nearest(slots(segments.select(*own)), marks, [k for k in keys if k in marks.columns], "mid", radius_us, "topic", same="app").where("topic IS NOT NULL")
    per = told.groupBy(*own, "topic").agg(F.sum("us").alias("us"))
    share = F.least(F.lit(1.0), F.col("sampled_us") / (F.col("end_us") - F.col("start_us")))
    return per.withColumn("us", F.floor(F.col("us") * share + 0.5)).groupBy(*keys, "topic").agg(F.sum("us").alias("us"))


def supported_tags(checked: DataFrame, propagated: DataFrame, frames: DataFrame, version: int) -> DataFrame:
    """Checked tags, and propagated ones of the current version, whose frame is still there at the very same moment.

    Tags: id, at_us, topic, status (propagated ones also version). The frame's app replaces the tag's hint.
    """
    tags = checked.select("id", "at_us", "topic", "status").unionByName(propagated.where(F.col("version") == version).select("id", "at_us", "topic", "status"))
    usable = tags.where(F.col("status").isin(*SUPPORTED) & (F.coalesce("topic", F.lit("")) != "") & F.col("at_us").isNotNull())
    return usable.join(frames.select("id", "at_us", F.col("app").alias("app_hint")), ["id", "at_us"])


def eligible_frames(frames: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """frames (id, keys, at_us, app, win, text, status) with why each is not to be read, by rank: ocr (not complete),
    titled, outside (of every span), sensitive; else ok."""
    inside = point_join(frames.select("id", *keys, "at_us"), spans, keys, how="left_semi").select("id").distinct().withColumn("__in", F.lit(True))
    rules = [("ocr", F.col("status") != "complete"), ("titled", F.coalesce("win", F.lit("")) != ""), ("outside", F.col("__in").isNull()), ("sensitive", T.is_sensitive(F.col("app"), F.col("text")))]
    return frames.join(inside, "id", "left").withColumn("reason", first_reason(rules)).drop("__in")


def evidence_pack(frames: DataFrame, files: DataFrame, keys: list[str], before_us: int = 120 * SECOND, after_us: int = SECOND, k: int = 3) -> DataFrame:
    """(id, kind, ref, rank): evidence around each frame (id, keys, at_us, app, win, text), from before_us to after_us.

    nearby: of the k latest other frames, those of the same window and UTC day that are not sensitive. file: of the k
    latest file events (ref, keys, at_us, name), those whose name, of four letters or more, is a word of title or text.
    Buckets of the window's length make the range joins equi-joins.
    """
    size = before_us + after_us
    low, high = F.floor((F.col("at_us") - before_us) / size), F.floor((F.col("at_us") + after_us - 1) / size)
    asked = frames.select("id", *keys, "at_us", F.explode(F.sequence(low, high)).alias("__b"))
    near = F.col("o_us").between(F.col("at_us") - before_us, F.col("at_us") + after_us - 1)

    def latest(rows: DataFrame) -> DataFrame:
        other = rows.select(*keys, "ref", F.col("at_us").alias("o_us"), F.floor(F.col("at_us") / size).alias("__b"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("o_us"), F.desc("ref"))).cast("long")
        return asked.join(other, [*keys, "__b"]).where(near).select("id", "ref", "o_us", "at_us").withColumn("rank", rank)

    own = frames.select("id", F.struct("app", "win").alias("own"), F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", "win", "text")), "[^a-z0-9]+", " "), F.lit(" ")).alias("words"))
    others = frames.select(F.col("id").alias("ref"), F.struct("app", "win").alias("other"), T.is_sensitive(F.col("app"), F.col("win")).alias("bad"))
    met = latest(frames.withColumn("ref", F.col("id"))).where("id <> ref").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("o_us"), F.desc("ref"))).cast("long")).where(F.col("rank") <= k)
    nearby = met.join(own.select("id", "own"), "id").join(others, "ref").where(F.col("own").eqNullSafe(F.col("other")) & ~F.col("bad") & (F.floor(F.col("at_us") / DAY) == F.floor(F.col("o_us") / DAY)))
    names = files.select("ref", F.lower("name").alias("name"))
    found = latest(files).where(F.col("rank") <= k).join(names, "ref").join(own.select("id", "words"), "id").where((F.length("name") >= 4) & F.contains(F.col("words"), F.concat(F.lit(" "), "name", F.lit(" "))))
    pick = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), "ref", "rank")
    return pick(nearby, "nearby").unionByName(pick(found, "file"))


def resolve_aliases(candidates: DataFrame, bindings: DataFrame) -> DataFrame:
    """candidates (id, observation, cited, candidate, task, project) with the one identity that an alias of theirs names.

    A binding (binding, project, observations, aliases) counts only if it is anchored by the candidate's observation, which
    the claim must cite; that of a task must belong to the resolved project. Several identities name none.
    """
    plain = lambda c: F.lower(T.squeezed(c))
    each = bindings.select("binding", F.col("project").alias("of"), F.explode("observations").alias("observation"), "aliases").select("binding", "of", "observation", F.explode("aliases").alias("alias"))
    each = each.select("binding", "of", "observation", plain(F.col("alias")).alias("alias")).distinct()
    one = lambda *keys: each.groupBy("observation", "alias", *keys).agg(F.when(F.count_distinct("binding") == 1, F.min("binding")).alias("resolved"))
    asked = candidates.where("cited AND candidate IS NOT NULL").select("id", "observation", "task", "project", plain(F.col("candidate")).alias("alias"))
    # A name is resolved once, however many claims use it.
    free = asked.where(~F.col("task")).join(one(), ["observation", "alias"]).select("id", "resolved")
    bound = asked.where("task").join(one("of").withColumnRenamed("of", "project"), ["observation", "alias", "project"]).select("id", "resolved")
    return candidates.join(free.unionByName(bound), "id", "left")


def visual_evidence(frames: DataFrame, captions: DataFrame, app: str | None) -> DataFrame:
    """Frames of one app (or of none) with their completed captions (id, ord, status, caption), in order."""
    own = frames.where(F.col("app").eqNullSafe(F.lit(app)))
    done = captions.where("status = 'complete'").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "caption"))), lambda s: s["caption"]).alias("captions"))
    return own.join(done, "id", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def window_captions(frames: DataFrame, captions: DataFrame, k: int = 2) -> DataFrame:
    """The first k completed captions (id, ord, status, caption) of each titled window, by the time of their frames;
    sensitive ones don't count."""
    usable = captions.where("status = 'complete'").where(~T.is_sensitive(F.col("caption")) & (F.col("caption") != ""))
    met = usable.join(frames.where(F.coalesce("win", F.lit("")) != "").select("id", "app", "win", "at_us"), "id")
    # By day first, so that the commonest title is not all of one task; what is left of it is k rows a day.
    order = ("at_us", "id", "ord")
    daily = F.row_number().over(Window.partitionBy("app", "win", "__day").orderBy(*order))
    met = met.withColumn("__day", F.floor(F.col("at_us") / DAY)).withColumn("r", daily).where(F.col("r") <= k)
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("app", "win").orderBy(*order))).where(F.col("r") <= k)
    return first.groupBy("app", "win").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "caption"))), lambda s: s["caption"]).alias("captions"))


def accepted_chapters(chapters: DataFrame, results: DataFrame) -> DataFrame:
    """Chapters (id, captions: array of model, caption) with the kind of their accepted result (id, status, kind); of the
    captions only the strong model's stay."""
    ok = results.where("status = 'complete'").select("id", "kind")
    return chapters.join(ok, "id").withColumn("captions", F.transform(F.filter("captions", lambda c: c["model"] == "strong"), lambda c: c["caption"]))


def run_annotations(runs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Frames that the latest completed run of each night and model completed: runs (run, night, model, started_us,
    finished_us, completed), annotations (path, model, status, at_us) updated inside it."""
    last = runs.where("completed").groupBy("night", "model").agg(F.max_by(F.struct("run", "started_us", "finished_us"), F.struct("started_us", "run")).alias("r")).select("night", "model", "r.*")
    spans = last.select("run", "night", "model", F.col("started_us").alias("start_us"), (F.col("finished_us") + 1).alias("end_us"))
    met = point_join(annotations.where("status = 'complete'").select("path", "model", "at_us"), spans, ["model"], bucket_us=DAY)
    return met.select("run", "night", "model", "path").distinct()


def private_fields(status: Column) -> Column:
    """Of a map of status fields, the known ones whose value is a code of safe shape."""
    return F.map_filter(status, lambda k, v: k.isin(*SAFE_FIELDS) & (v.isNull() | v.rlike(SAFE_CODE)))


def search(records: DataFrame, text: str, device: int | None = None, k: int = 50) -> DataFrame:
    """The first k records (device, start_us, label, apps) whose label or apps have a text in any case."""
    whole = F.lower(F.concat_ws(" ", "label", F.array_join("apps", " ")))
    found = records.where(F.contains(whole, F.lit(text.strip().lower())))
    found = found if device is None else found.where(F.col("device") == device)
    return found.orderBy("start_us", "device", "label").limit(k)


def _specific(tags: DataFrame) -> DataFrame:
    """(__a, __w, topic): one topic a window, of several the first; a topic without a subject is none."""
    told = tags.where((F.col("status") == "model_inference") & (F.size(T.subject_tokens(F.col("topic"))) > 0))
    return told.groupBy(F.col("app").alias("__a"), F.col("win").alias("__w")).agg(F.min("topic").alias("topic"))


def allocate_topics(segments: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Active time by keys, label and status: a window's specific topic (app, win, topic, status), else its broad context.

    One tag a window: of several, the first by topic. A topic without a subject is none.
    """
    told = segments.where("state = 'active'").join(_specific(tags), F.col("app").eqNullSafe(F.col("__a")) & (F.col("win") == F.col("__w")), "left")
    broad = T.broad_context(F.col("win"), F.col("app"))
    status = F.when(F.col("topic").isNotNull(), "specific_model").when(F.col("label") == "Unclear", "unclassified").otherwise("broad_context")
    return told.withColumn("label", F.coalesce("topic", broad)).withColumn("status", status).groupBy(*keys, "label", "status").agg(F.sum("sampled_us").alias("us"))


def topic_stretches(segments: DataFrame, tags: DataFrame, keys: list[str], gap_us: int = SECOND) -> DataFrame:
    """Stretches of one specific topic or one exact window: label, status, start_us, end_us, sampled us, apps in the order
    they were first seen, whether the context `switched` into the stretch, and changes of window in it.

    Several apps may share a stretch only by their topic; a sensitive title has none. Whatever is not active, has no
    sampled time or no length, and a gap of more than gap_us, ends a stretch, and what follows it is no switch. Without a
    title the label is the broad context.
    """
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    hidden, title = T.is_sensitive(F.col("win")), F.coalesce("win", F.lit(""))
    told = segments.join(_specific(tags), F.col("app").eqNullSafe(F.col("__a")) & (F.col("win") == F.col("__w")), "left").drop("__a", "__w")
    told = told.withColumn("topic", F.when(~hidden, F.col("topic")))
    told = told.withColumn("label", F.coalesce("topic", F.when((title != "") & ~hidden, F.left("win", F.lit(160))), T.broad_context(F.col("win"), F.col("app"))))
    exact = F.struct(F.coalesce("app", F.lit("")), title)
    told = told.withColumns({"__seen": F.coalesce((F.col("state") == "active") & (F.col("sampled_us") > 0) & (F.col("end_us") > F.col("start_us")), F.lit(False)), "__win": exact, "__own": F.struct("topic", F.when(F.col("topic").isNull(), exact))})
    told = told.withColumn("__next", F.col("__seen") & F.coalesce(F.lag("__seen").over(w) & (F.col("start_us") - F.lag("end_us").over(w)).between(0, gap_us), F.lit(False)))
    other = lambda c: F.col("__next") & ~F.lag(c).over(w).eqNullSafe(F.col(c))
    told = told.withColumns({"__moved": other("__own"), "__turned": other("__win")})
    told = told.withColumn("__n", F.sum((F.col("__seen") & (~F.col("__next") | F.col("__moved"))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    apps = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("start_us", "app"))), lambda x: x.app), lambda a: a != "")
    return (
        told.where("__seen")
        .groupBy(*keys, "__n")
        .agg(
            F.min("label").alias("label"),
            F.min(F.when(F.col("topic").isNotNull(), "specific_model").otherwise("observed_window")).alias("status"),
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("sampled_us").alias("us"),
            F.array_distinct(apps).alias("apps"),
            F.max("__moved").alias("switched"),
            F.sum(F.col("__turned").cast("long")).alias("window_switches"),
        )
        .drop("__n")
    )


def stretch_measures(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Of topic_stretches() by keys: stretches, switches of context and window, sampled time, context switches an hour of
    it in thousandths, median and longest, time in those of 20 minutes or more, and how many last below 2 minutes.

    With keys without the day these are a period's: the rate is made of sums, and the median of all its stretches.
    """
    told = stretches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if("switched").alias("context_switches"),
        F.sum("window_switches").alias("window_switches"),
        F.sum("us").alias("us"),
        F.floor(F.median("us")).alias("median_us"),
        F.max("us").alias("longest_us"),
        F.sum(F.when(F.col("us") >= 1200 * SECOND, F.col("us")).otherwise(0)).alias("sustained_us"),
        F.count_if(F.col("us") < 120 * SECOND).alias("brief"),
    )
    return told.withColumn("switches_per_hour_x1000", F.expr(f"CAST(CAST(context_switches AS DECIMAL(38, 0)) * 1000 * {HOUR} div us AS BIGINT)"))


def fresh_hypotheses(hypotheses: DataFrame, episodes: DataFrame, sources: DataFrame, runtime: dict[str, str], version: int) -> DataFrame:
    """hypotheses with why each may not be used, by rank; ok if all still matches.

    hypotheses: id, version, tier, episode, episode_sha, observation, at_us, low_us, high_us, image_sha, model_sha.
    episodes: episode, sha, start_us, end_us, state, barrier. sources: observation, at_us, image_sha. runtime: model_sha.
    """
    e = episodes.select("episode", F.col("sha").alias("e_sha"), F.col("start_us").alias("e_start"), F.col("end_us").alias("e_end"), "state", "barrier")
    s = sources.select("observation", F.col("at_us").alias("s_us"), F.col("image_sha").alias("s_image"))
    met = hypotheses.join(e, "episode", "left").join(s, "observation", "left")
    rules = [
        ("version", F.col("version") != version),
        ("tier", F.col("tier") != "model_hypothesis"),
        ("episode_missing", F.col("e_sha").isNull()),
        ("episode_changed", F.col("e_sha") != F.col("episode_sha")),
        ("source_missing", F.col("s_us").isNull()),
        ("source_moved", F.col("s_us") != F.col("at_us")),
        ("image_changed", F.col("s_image") != F.col("image_sha")),
        ("runtime_changed", reduce(lambda a, c: a | (F.col(c) != runtime[c]), runtime, F.lit(False))),
        ("scope", ~((F.col("e_start") <= F.col("low_us")) & (F.col("low_us") <= F.col("at_us")) & (F.col("at_us") < F.col("high_us")) & (F.col("high_us") <= F.col("e_end")))),
        ("not_foreground", ~F.col("state").isin("active", "unattributed")),
        ("barrier", F.col("barrier")),
        ("too_long", F.col("high_us") - F.col("low_us") > MINUTE),
    ]
    return met.select("id", first_reason(rules).alias("reason"))


def chapters(segments: DataFrame, step_us: int, keys: list[str]) -> DataFrame:
    """Active time by keys and slot of step_us, with the window that has most of it (the first by name on a tie), and its time."""
    from spanloom.operators.interval import cut

    parts = cut(segments.where("state = 'active'").select(*keys, "start_us", "end_us", "app", "win"), step_us)
    per = parts.groupBy(*keys, "slot", "app", "win").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    top = F.min_by(F.struct("app", "win", "us"), F.struct(-F.col("us"), F.concat_ws("/", "app", "win")))
    return per.groupBy(*keys, "slot").agg(F.sum("us").alias("us"), top.alias("top")).select(*keys, "slot", "us", F.col("top.app").alias("app"), F.col("top.win").alias("win"), F.col("top.us").alias("top_us"))


def summary_coverage(blocks: DataFrame, inputs: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """By summary: its blocks and their amount, and how much of that is in its input and is cited.

    blocks: key, block, amount, complete. inputs and cited: key, ids (array of blocks). Ids count once; only those of
    complete blocks count, and a cited one only if it was in the input.
    """
    each = lambda df, name: df.select(key, F.explode("ids").alias("block")).distinct().withColumn(name, F.lit(True))
    met = blocks.join(each(inputs, "__in"), [key, "block"], "left").join(each(cited, "__cited"), [key, "block"], "left")
    ok = F.col("complete") & F.col("__in").isNotNull()
    seen = ok & F.col("__cited").isNotNull()
    amount = lambda c: F.sum(F.when(c, F.col("amount")).otherwise(0))
    return met.groupBy(key).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("complete").alias("complete"), F.sum("amount").alias("amount"),
        F.count_if(ok).alias("input_blocks"), amount(ok).alias("input_amount"), F.count_if(seen).alias("cited_blocks"), amount(seen).alias("cited_amount"),
    )


def current_summaries(cited: DataFrame, themes: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, current): whether a summary may be shown still.

    cited: key, block, input_sha as it was then. themes: key, ids. blocks: key, block, input_sha now. It must cite
    something, no block twice, every block must exist with the same input, and each theme must cite some of these only.
    """
    now = blocks.select(key, "block", F.col("input_sha").alias("now"))
    per = cited.join(now, [key, "block"], "left").groupBy(key, "block").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("now") == F.col("input_sha"), F.lit(False))).alias("ok"))
    base = per.groupBy(key).agg((F.bool_and("ok") & (F.max("n") == 1)).alias("ok"))
    told = themes.select(key, F.explode_outer(F.when(F.size("ids") > 0, F.col("ids"))).alias("block")).distinct()
    lost = told.join(per.select(key, "block").withColumn("__in", F.lit(True)), [key, "block"], "left").groupBy(key).agg(F.bool_or(F.col("__in").isNull()).alias("lost"))
    keys = cited.select(key).unionByName(themes.select(key)).distinct()
    return keys.join(base, key, "left").join(lost, key, "left").select(key, (F.coalesce("ok", F.lit(False)) & ~F.coalesce("lost", F.lit(False))).alias("current"))


def reuse_or_pending(candidates: DataFrame, cache: DataFrame, model: str, version: int, least: int = 60) -> DataFrame:
    """candidates (id, input_sha, amount) with their lane: cached if a final result of the same input, model and version is
    there (id, input_sha, model, version, status), insufficient_context below `least`, else pending."""
    usable = (F.col("model") == model) & (F.col("version") == version) & F.col("status").isin("complete", "insufficient_context")
    hit = cache.where(usable).select("id", "input_sha").distinct().withColumn("__hit", F.lit(True))
    return candidates.join(hit, ["id", "input_sha"], "left").withColumn("lane", F.when(F.col("__hit"), "cached").when(F.col("amount") < least, "insufficient_context").otherwise("pending")).drop("__hit")


def merge_groups(blocks: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Groups of blocks as a model named them, made whole: (key, label, blocks, amount, status).

    blocks: key, block, amount. groups: key, ord, label, ids. A block belongs to the first group that has it; ids of no
    block count for nothing; labels that differ in case only are one, under the first one's writing; blocks in no group
    are Unclear, merged with a group of that name.
    """
    each = groups.select(key, "ord", "label", F.explode("ids").alias("block"))
    owner = each.groupBy(key, "block").agg(F.min_by(F.struct("ord", "label"), "ord").alias("g"))
    met = blocks.join(owner, [key, "block"], "left").withColumns({"ord": F.coalesce("g.ord", F.lit(1 << 40)), "label": F.coalesce("g.label", F.lit("Unclear"))})
    first = F.min_by(F.struct("label", F.col("g").isNull().alias("rest")), F.struct("ord", "label"))
    out = met.groupBy(key, F.lower("label").alias("__l")).agg(first.alias("f"), F.count(F.lit(1)).alias("blocks"), F.sum("amount").alias("amount"))
    return out.select(key, F.col("f.label").alias("label"), "blocks", "amount", F.when(F.col("f.rest"), "unclassified").otherwise("model_inference").alias("status"))


def promotion(reviews: DataFrame, trials: DataFrame, key: str) -> DataFrame:
    """(key, enabled): a review id is there, it is switched on, and three different trial dates or more are."""
    dates = trials.groupBy(key).agg(F.count_distinct("date").alias("dates"))
    met = reviews.join(dates, key, "left")
    return met.select(key, (F.col("switched_on") & (F.coalesce("review_id", F.lit("")) != "") & (F.coalesce("dates", F.lit(0)) >= 3)).alias("enabled"))


def continuity(measures: DataFrame, histogram: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Over the days that are there: sums, the longest stretch, and switches for each identified hour, in tenths, from the
    sums; and the histogram's sums by bucket. measures: keys, us, switches, sessions, longest_us, sustained_us."""
    total = measures.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("us", "switches", "sessions", "sustained_us")], F.max("longest_us").alias("longest_us"), F.count(F.lit(1)).alias("days"))
    rate = F.floor(F.try_divide(F.col("switches") * 36_000_000_000.0, F.col("us").cast("double")) + 0.5)
    return total.withColumn("switches_per_hour_x10", rate), histogram.groupBy(*keys, "bucket").agg(F.sum("sessions").alias("sessions"), F.sum("us").alias("us"))
