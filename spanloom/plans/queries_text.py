"""Queries of text hygiene, annotation validation, labels and log metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.plans.book import Book
from spanloom.sources import adapters as V

BOOK = Book()
query = BOOK.query
QUERIES, SQL = BOOK.queries, BOOK.sql


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ONE = r"regexp_replace(regexp_replace(coalesce({t}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'), '^ | $', '', 'g')"
CLEAN = "regexp_replace(regexp_replace({x}, " + _q(T.EMAIL) + ", '[email]', 'g'), " + _q(T.URL) + ", '[url]', 'g')"


def _one(t: str) -> str:
    return ONE.replace("{t}", t)


def _clean(x: str) -> str:
    return CLEAN.replace("{x}", x)


def _docs(spark, d):
    return V.table(spark, d, "documents")


@query(f"WITH o AS (SELECT doc_id, {_one('text')} AS one FROM documents) SELECT doc_id, CASE WHEN regexp_matches(one, {_q(T.SENSITIVE)}) THEN '[withheld]' ELSE left({_clean('one')}, 160) END AS safe FROM o")
def safe_text(spark, d):
    return _docs(spark, d).select("doc_id", T.safe_text(F.col("text")).alias("safe"))


@query(f"WITH o AS (SELECT doc_id, left({_one('text')}, 160) AS one FROM documents) SELECT doc_id, CASE WHEN regexp_matches(one, {_q(T.SENSITIVE)}) THEN '[withheld]' ELSE {_clean('one')} END AS safe FROM o")
def safe_input_text(spark, d):
    return _docs(spark, d).select("doc_id", T.cut_text(F.col("text")).alias("safe"))


TURN = "conv_id, turn"


@query(
    rf"""WITH t AS (SELECT {TURN}, CASE WHEN turn % 2 = 0 THEN 'thinking </think> ' || text ELSE text END AS s FROM conversations), l AS (SELECT {TURN}, list_last(string_split(s, '</think>')) AS s FROM t),
    c AS (SELECT {TURN}, {_one("regexp_replace(" + _clean("s") + ", " + _q(T.LONG_NUMBER) + ", '[number]', 'g')")} AS s FROM l) SELECT {TURN}, CASE WHEN length(s) > 0 AND length(s) <= 320 THEN s END AS description FROM c"""
)
def redact_description(spark, d):
    s = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("thinking </think> "), "text")).otherwise(F.col("text"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.redact_description(s).alias("description"))


@query(
    f"""SELECT {TURN}, CASE WHEN text IS NULL OR length(text) < 3 THEN 'too_short' WHEN length(text) > 400 THEN 'too_long' WHEN regexp_matches(text, {_q(T.SENSITIVE)}) THEN 'sensitive' WHEN regexp_matches(text, {_q(T.URL)}) THEN 'url'
    WHEN regexp_matches(text, {_q(T.EMAIL)}) THEN 'email' WHEN regexp_matches(text, {_q(T.LONG_NUMBER)}) THEN 'number' WHEN regexp_matches(text, {_q(T.COMPLETION)}) THEN 'completion_claim' ELSE 'ok' END AS code FROM conversations"""
)
def validate_text(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.failure_code(F.col("text")).alias("code"))


@query(rf"WITH t AS (SELECT {TURN}, CASE WHEN turn % 3 = 0 THEN 'x</think> ```json ' || text || '```' ELSE text END AS s FROM conversations), l AS (SELECT {TURN}, list_last(string_split(s, '</think>')) AS s FROM t), f AS (SELECT *, regexp_extract(s, '(?s)```(?:json)?\s*(.*?)```', 1) AS inner_s FROM l) SELECT {TURN}, trim(CASE WHEN inner_s <> '' THEN inner_s ELSE s END, ' ') AS answer FROM f")
def final_answer_json(spark, d):
    s = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x</think> ```json "), "text", F.lit("```"))).otherwise(F.col("text"))
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.final_answer(s).alias("answer"))


def _ladder(title: str, app: str, host: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower(coalesce({title}, '')), '{'|'.join(w)}') THEN '{label}'" for w, label in T.CONTEXTS)
    page = f"CASE WHEN coalesce({host}, '') <> '' THEN left({host}, 80) || ' (topic unknown)' ELSE 'Browser page (topic unknown)' END"
    return f"""CASE WHEN coalesce(regexp_matches({title}, {_q(T.SENSITIVE)}), false) THEN 'Sensitive window (topic hidden)' {rules}
      WHEN coalesce({app}, '') = '' THEN 'Unclear' WHEN regexp_matches(lower({app}), '{'|'.join(T.BROWSERS)}') THEN {page} ELSE left({app}, 60) || ' (task unknown)' END"""


TITLES = """p AS (SELECT page_id, CASE page_id % 13 WHEN 0 THEN 'Bank Account' WHEN 1 THEN 'YouTube Music - mix' WHEN 2 THEN 'My Video' WHEN 3 THEN 'ChatGPT' WHEN 4 THEN 'Gmail inbox' WHEN 5 THEN 'Budget spreadsheet' WHEN 6 THEN 'Terminal'
      ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title, CASE page_id % 4 WHEN 0 THEN 'Google Chrome' WHEN 1 THEN 'Editor' WHEN 2 THEN '' END AS app, CASE WHEN page_id % 8 <> 0 THEN regexp_extract(url, '://([^/?#]*)', 1) END AS host FROM pages)"""


@query(f"WITH {TITLES} SELECT page_id, {_ladder('title', 'app', 'host')} AS label FROM p")
def broad_context(spark, d):
    """Titles of pages, some replaced by telling ones, with an app and a site."""
    k = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    for i, known in enumerate(("Bank Account", "YouTube Music - mix", "My Video", "ChatGPT", "Gmail inbox", "Budget spreadsheet", "Terminal")):
        title = F.when(k % 13 == i, known).otherwise(title)
    app = F.when(k % 4 == 0, "Google Chrome").when(k % 4 == 1, "Editor").when(k % 4 == 2, "")
    host = F.when(k % 8 != 0, F.regexp_extract("url", "://([^/?#]*)", 1))
    return V.table(spark, d, "pages").select("page_id", T.broad_context(title, app, host).alias("label"))


@query(
    f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda w: (length(w) >= 4 OR list_contains({list(T.SHORT_SUBJECTS)}, w)) AND NOT list_contains({list(T.GENERIC)}, w)), lambda w: regexp_replace(w, 's+$', '')))), ' ') AS tokens FROM conversations"""
)
def subject_tokens(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.subject_tokens(F.col("text")), " ").alias("tokens"))


@query(
    """WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 4)) AS w FROM conversations),
    p AS (SELECT b.conv_id, b.turn, list_has_any(a.w, b.w) AS supported FROM w b JOIN w a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1) SELECT conv_id, turn, supported FROM p"""
)
def supported_topic(spark, d):
    """Whether a turn shares a longer word with the turn before."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 4))
    c = V.table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("w0"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.arrays_overlap("w", "w0").alias("supported"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    k AS (SELECT doc_id, n, unnest(['home_path', 'credential', 'email', 'phone']) AS kind, unnest([regexp_matches(s, {_q(T.HOME_PATH)}), regexp_matches(s, {_q(T.CREDENTIAL)}), regexp_matches(s, {_q(T.EMAIL)}), regexp_matches(s, {_q(T.PHONE)})]) AS hit FROM l)
    SELECT doc_id, kind, count(*) AS lines, min(n) AS first_line FROM k WHERE hit GROUP BY ALL"""
)
def text_scan(spark, d):
    return T.line_scan(_docs(spark, d), "doc_id", "text")


RULES = [(r"\bidiot\b", "[word]"), (r"[0-9]{4,}", "[n]"), ("src", "source")]


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\bidiot\b', '[word]', 'g'), '[0-9]{{4,}}', '[n]', 'g'), 'src', 'source', 'g')) AS digest FROM documents")
def redact_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.redact_rules(F.col("text"), RULES)).alias("digest"))


@query(
    rf"""WITH p AS (SELECT b.conv_id, b.turn, b.text AS t, a.text AS s FROM conversations b JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(t), '[a-z]{{3,}}')) AS wt, list_distinct(regexp_extract_all(lower(s), '[a-z]{{3,}}')) AS ws FROM p)
    SELECT conv_id, turn, regexp_matches(t, {_q(T.UNCLEAR)}) AS unclear, regexp_matches(t, {_q(T.COMPLETION)}) AS claims_done, CASE WHEN len(wt) > 0 THEN CAST(len(list_intersect(wt, ws)) * 1000 // len(wt) AS BIGINT) END AS overlap_permille FROM w"""
)
def lexical_flags(spark, d):
    c = V.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("t").alias("s"))
    return T.lexical_flags(c.join(before, ["conv_id", "turn"]), "t", "s").drop("t", "s")


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'locked' WHEN value >= 180 THEN 'idle' ELSE 'window' END AS state FROM events")
def coarse_state(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), T.coarse_state(F.col("event_type") == "error", F.col("value")).alias("state"))


@query("SELECT event_id AS id, CAST(CASE WHEN value * 40 <= 0 THEN 0 WHEN value * 40 < 900 THEN 1 WHEN value * 40 < 1800 THEN 2 WHEN value * 40 < 2700 THEN 3 ELSE 4 END AS BIGINT) AS level FROM events")
def heat_level(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), T.heat_level(F.col("value") * 40).alias("level"))


@query("SELECT event_id AS id, CASE WHEN value - 50 >= 0 THEN value - 50 END AS measured FROM events")
def measured(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), T.measured(F.col("value") - 50).alias("measured"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 900 AS DOUBLE) AS eval_ms, CAST(o_orderkey % 70 AS DOUBLE) AS eval_tokens, CASE WHEN o_orderkey % 900 > 0 THEN CAST(floor((o_orderkey % 70) * 1000.0 / (o_orderkey % 900) + 0.5) AS BIGINT) END AS rate FROM orders")
def engine_timings(spark, d):
    """Timings out of raw log texts, one log an order."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("load\nprompt eval time = 12.5 ms\neval time = "), (F.col("o_orderkey") % 900).cast("string"), F.lit(" ms / "), (F.col("o_orderkey") % 70).cast("string"), F.lit(" runs\n")).alias("log"))
    t = T.engine_timings(o, "log")
    return t.select("id", "eval_ms", "eval_tokens", F.floor(F.col("tokens_per_s") + 0.5).alias("rate"))


BUNDLES = "CASE p_partkey % 6 WHEN 0 THEN 'com.vendor' || (p_partkey % 40)::VARCHAR || '.' || replace(lower(p_name), ' ', '_') WHEN 1 THEN 'com.apple.mobilenotes' WHEN 2 THEN 'net.whatsapp.WhatsApp' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE p_brand END"


@query(
    f"""WITH b AS (SELECT p_partkey AS id, {BUNDLES} AS bundle FROM part)
    SELECT id, CASE WHEN coalesce(bundle, '') = '' THEN 'Unknown app' WHEN bundle = 'com.apple.mobilenotes' THEN 'Notes' WHEN bundle = 'net.whatsapp.WhatsApp' THEN 'WhatsApp'
      WHEN starts_with(bundle, 'com.') THEN array_to_string(list_transform(string_split(replace(list_last(string_split(bundle, '.')), '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') ELSE bundle END AS app FROM b"""
)
def app_name(spark, d):
    k = F.col("p_partkey")
    vendor = F.concat(F.lit("com.vendor"), (k % 40).cast("string"), F.lit("."), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")))
    bundle = F.when(k % 6 == 0, vendor).when(k % 6 == 1, "com.apple.mobilenotes").when(k % 6 == 2, "net.whatsapp.WhatsApp").when(k % 6 == 4, "").when(k % 6 == 5, F.col("p_brand"))
    return V.table(spark, d, "part").select(k.alias("id"), T.app_name(bundle).alias("app"))


def _records(spark, d):
    """Model annotations as JSON: a topic, its confidence and the turns it cites."""
    c = V.table(spark, d, "conversations")
    cited = F.when(F.col("turn") % 5 == 0, F.array(F.col("turn"), F.col("turn") + 100)).otherwise(F.array(F.col("turn")))
    topic = F.when(F.col("turn") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("t"), F.col("turn").cast("string")))
    conf = F.when(F.col("turn") % 4 == 0, "certain").otherwise("high")
    good = F.to_json(F.struct(topic.alias("topic"), conf.alias("confidence"), cited.alias("cites")), {"ignoreNullFields": "false"})
    return c.select("conv_id", "turn", F.when(F.col("turn") % 11 == 0, F.lit("{broken")).otherwise(good).alias("record"))


@query(
    """WITH n AS (SELECT conv_id, list(turn) AS turns FROM conversations GROUP BY conv_id)
    SELECT c.conv_id, turn, CASE WHEN turn % 11 = 0 THEN 'malformed' WHEN turn % 7 = 0 THEN 'no_topic' WHEN turn % 4 = 0 THEN 'bad_confidence' WHEN turn % 5 = 0 THEN 'unknown_citation' ELSE 'ok' END AS code FROM conversations c"""
)
def validate_records(spark, d):
    """The first rule that a JSON annotation breaks: shape, topic, confidence, cited turns that exist."""
    rows = _records(spark, d).withColumn("r", F.from_json("record", "topic STRING, confidence STRING, cites ARRAY<BIGINT>"))
    cited = rows.select("conv_id", "turn", "record", F.explode("r.cites").alias("cite"))
    turns = rows.select("conv_id", F.col("turn").alias("cite")).distinct()
    # Turns are met one by one, so a long conversation is no long row.
    missed = cited.join(turns, ["conv_id", "cite"], "left_anti").select(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "turn", "record")]).distinct()
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & F.col("turn").eqNullSafe(F.col("__turn")) & (F.col("record") == F.col("__record"))
    told = rows.join(missed, same, "left")
    code = (
        F.when(F.col("r.cites").isNull(), "malformed")
        .when(F.col("r.topic").isNull(), "no_topic")
        .when(~F.col("r.confidence").isin("low", "medium", "high"), "bad_confidence")
        .when(F.col("__record").isNotNull(), "unknown_citation")
        .otherwise("ok")
    )
    return told.select("conv_id", "turn", code.alias("code"))


@query("SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS display FROM pages")
def display_id(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("display"))


