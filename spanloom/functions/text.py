"""Text rules as columns: hygiene, validation and labels."""

from __future__ import annotations

import pandas as pd
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as sensitive, as an address, as a number that identifies. Word bounds are written out, since Java
# and RE2 differ on what is a word at \b.
SENSITIVE = (
    r"(?i)(^|[^A-Za-z0-9_])(password|passcode|verification code|one.time code|recovery key|credit card|bank account|"
    r"social security|api key|keychain|1password|bitwarden|dashlane|proton pass|suicid(?:e|al)|self.harm|kill myself|"
    r"hurt myself)([^A-Za-z0-9_]|$)"
)
HEALTH = r"(?i)(^|[^A-Za-z0-9_])(doctor|dentist|therapy|hospital|medical|medication|pharmacy|clinic|healthcare)([^A-Za-z0-9_]|$)"
SENSITIVE_APPS = (
    "com.1password.1password", "com.agilebits.onepassword7", "com.bitwarden.desktop", "com.apple.passwords",
    "com.apple.keychainaccess", "com.apple.securityagent", "com.apple.loginwindow", "com.apple.systempreferences",
    "keepassxc", "dashlane",
)
SENSITIVE_VENDORS = ("1password", "bitwarden", "keepassxc", "dashlane")
SENSITIVE_TITLES = ("password", "passcode", "verification code", "recovery key", "one-time code", "security code", "credit card", "bank account")
URL = r"(?i)(https?://|www\.)[^\s]+"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LONG_NUMBER = r"[0-9]{6,}"
HOME_PATH = r"(/Users/|/home/)[A-Za-z0-9_.-]+"
CREDENTIAL = r"(?i)(api[_-]?key|secret|passwd|password)[\"']? *[:=]"
PHONE = r"\+[0-9][0-9 ().-]{7,}[0-9]"
COMPLETION = (
    r"(?i)(^|[^A-Za-z0-9_])(completed|finished|submitted|published|delivered|sent|saved|finalized|achieved|deployed|resolved|"
    r"launched|released|merged|shipped|purchased|deleted|emailed|posted)([^A-Za-z0-9_]|$)"
)
UNCLEAR = r"(?i)(^|[^A-Za-z])(unclear|unknown|cannot tell)([^A-Za-z]|$)"


def squeezed(text: Column) -> Column:
    """ASCII white space in runs becomes one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "), "^ | $", "")


def safe_text(text: Column, most: int = 160) -> Column:
    """Squeezed; withheld if sensitive; e-mail and web addresses replaced; then cut to `most` characters."""
    one = squeezed(F.coalesce(text, F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(one, EMAIL, "[email]"), URL, "[url]")
    return F.when(one.rlike(SENSITIVE), F.lit("[withheld]")).otherwise(F.left(clean, F.lit(most)))


def cut_text(text: Column, most: int = 160) -> Column:
    """The other order: cut first, then replace; what the cut splits is no address any more."""
    one = F.left(squeezed(F.coalesce(text, F.lit(""))), F.lit(most))
    return F.when(one.rlike(SENSITIVE), F.lit("[withheld]")).otherwise(F.regexp_replace(F.regexp_replace(one, EMAIL, "[email]"), URL, "[url]"))


def redact_description(text: Column, most: int = 320) -> Column:
    """What follows the last </think>, without terminal codes, addresses and long numbers; null if empty or too long."""
    tail = F.substring_index(text, "</think>", -1)
    clean = F.regexp_replace(tail, r"\x1B\[[0-9;]*[A-Za-z]", "")
    for pattern, to in ((EMAIL, "[email]"), (URL, "[url]"), (LONG_NUMBER, "[number]")):
        clean = F.regexp_replace(clean, pattern, to)
    clean = squeezed(clean)
    return F.when((F.length(clean) > 0) & (F.length(clean) <= most), clean)


def failure_code(text: Column, least: int = 3, most: int = 400) -> Column:
    """The first rule that a text breaks, or ok."""
    n = F.length(F.coalesce(text, F.lit("")))
    return (
        F.when(text.isNull() | (n < least), "too_short")
        .when(n > most, "too_long")
        .when(text.rlike(SENSITIVE), "sensitive")
        .when(text.rlike(URL), "url")
        .when(text.rlike(EMAIL), "email")
        .when(text.rlike(LONG_NUMBER), "number")
        .when(text.rlike(COMPLETION), "completion_claim")
        .otherwise("ok")
    )


def final_answer(text: Column) -> Column:
    """The answer behind a closed thinking block, out of a code fence if it is in one."""
    tail = F.substring_index(text, "</think>", -1)
    fenced = F.regexp_extract(tail, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(fenced != "", fenced).otherwise(tail))


# Title words and the label they give, in order; browsers, whose site is told instead of the app.
CONTEXTS = (
    (("youtube music",), "Music site (subject unknown)"),
    (("youtube", "video"), "Video site (subject unknown)"),
    (("chatgpt", "claude"), "AI chat (subject unknown)"),
    (("gmail", "mail", "messages"), "Messages (subject unknown)"),
    (("sheets", "spreadsheet"), "Spreadsheet (subject unknown)"),
    (("docs", "document"), "Document (subject unknown)"),
    (("github", "codex", "terminal"), "Development tool (task unknown)"),
    (("chess",), "Chess context (activity unknown)"),
    (("instagram", "twitter", "reddit"), "Social feed (subject unknown)"),
)
BROWSERS = ("chrome", "safari", "firefox", "edge", "arc")


def broad_context(title: Column, app: Column, host: Column | None = None) -> Column:
    """An honest coarse label: of a sensitive title none, else by words of the title, else the site or the app."""
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(app, F.lit("")))
    named = F.coalesce(app, F.lit("")) != ""
    page = F.lit("Browser page (topic unknown)")
    if host is not None:
        page = F.when(F.coalesce(host, F.lit("")) != "", F.concat(F.left(host, F.lit(80)), F.lit(" (topic unknown)"))).otherwise(page)
    out = F.when(named & a.rlike("|".join(BROWSERS)), page).when(named, F.concat(F.left(app, F.lit(60)), F.lit(" (task unknown)"))).otherwise("Unclear")
    for words, label in reversed(CONTEXTS):
        out = F.when(t.rlike("|".join(words)), label).otherwise(out)
    return F.when(F.coalesce(title.rlike(SENSITIVE), F.lit(False)), "Sensitive window (topic hidden)").otherwise(out)


def is_sensitive(*texts: Column) -> Column:
    """Whether the texts together, nulls left out, have a sensitive word."""
    return F.concat_ws(" ", *texts).rlike(SENSITIVE)


def sensitive_context(app: Column, title: Column) -> Column:
    """Why a screen must not be kept: no known app, a sensitive one, or a sensitive title; else null."""
    a, t = F.lower(app), F.lower(title)
    bad_app = a.isin(*SENSITIVE_APPS) | a.rlike("|".join(SENSITIVE_VENDORS))
    return (
        F.when(F.coalesce(app, F.lit("")) == "", "unknown_frontmost_app")
        .when(bad_app, "sensitive_app")
        .when(F.coalesce(t.rlike("|".join(SENSITIVE_TITLES)), F.lit(False)), "sensitive_window_title")
    )


def derive_state(source: Column, title: Column) -> Column:
    """The state that a sample's source tells; a window without a title is unattributed; other sources tell none."""
    window = F.when(F.coalesce(title, F.lit("")) == "", "unattributed").otherwise("active")
    return F.when(source.isin("window", "window_legacy"), window).when(source.isin("idle", "idle_legacy"), "idle").when(source == "locked", "locked")


def normalize(text: Column) -> Column:
    """Compatibility-composed (NFKC), case-folded, white space squeezed: what two writings of one thing share.

    Spark has neither form as a function, so texts pass through Arrow in batches.
    """
    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFKC").str.casefold().str.split().str.join(" ")

    return fold(text)


# Words that tell no subject, and short ones that do.
GENERIC = (
    "window", "browser", "chrome", "safari", "video", "watching", "research", "content", "page", "online", "website", "task",
    "work", "activity", "general", "media", "social", "unclear", "other", "with", "about", "youtube", "chatgpt", "google",
    "instagram", "reddit", "browsing",
)
SHORT_SUBJECTS = ("seo", "sql", "api", "llm", "ui", "ux", "cv")


def subject_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words of a subject: four letters or more or a known short one, no generic ones, without a
    final s, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    kept = F.filter(words, lambda w: ((F.length(w) >= 4) | w.isin(*SHORT_SUBJECTS)) & ~w.isin(*GENERIC))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, "s+$", ""))))


# Names of bundles whose last part says little.
APP_NAMES = {
    "com.atebits.Tweetie2": "X",
    "com.chess.iphone": "Chess",
    "com.facebook.hatch": "Instagram",
    "com.google.ios.youtubemusic": "YouTube Music",
    "com.apple.MobileSMS": "Messages",
    "com.google.Gmail": "Gmail",
    "com.openai.chat": "ChatGPT",
    "com.linkedin.LinkedIn": "LinkedIn",
    "com.google.ios.youtube": "YouTube",
    "com.google.chrome.ios": "Chrome",
    "com.apple.control-center": "Control Center",
    "com.apple.InCallService": "Phone calls",
    "com.apple.camera": "Camera",
    "net.whatsapp.WhatsApp": "WhatsApp",
    "com.apple.SleepLockScreen": "Lock Screen",
    "com.google.Maps": "Google Maps",
    "com.apple.mobilenotes": "Notes",
    "com.apple.springboard.app-library-open-pod": "App Library",
    "com.apple.springboard.today-view": "Today View",
    "com.apple.springboard.stand-by": "StandBy",
    "com.industriousoffice.app": "Industrious",
    "com.toyopagroup.picaboo": "Snapchat",
}


def app_name(bundle: Column, names: dict[str, str] | None = None) -> Column:
    """A name to show: a known one, the last part of a com. bundle in words with capitals, or the value itself."""
    known = F.create_map(*[F.lit(x) for pair in (names or APP_NAMES).items() for x in pair])
    last = F.initcap(F.replace(F.substring_index(bundle, ".", -1), F.lit("_"), F.lit(" ")))
    return F.when(F.coalesce(bundle, F.lit("")) == "", "Unknown app").when(known[bundle].isNotNull(), known[bundle]).when(bundle.startswith("com."), last).otherwise(bundle)


# Folders whose files are generated or of a running program, and ends of names of such files.
GENERATED_DIRS = (
    ".git", "node_modules", ".venv", "venv", "dist", "build", ".next", ".cache", "vendor", "coverage", "__pycache__", "data",
    "out", "static-pages", "static-catalog", "logs", "runtime", "state", "site-packages", "test-results", "playwright-report", "target",
)
RUNTIME_SUFFIXES = (".log", ".sqlite", ".sqlite3", ".sqlite3-wal", ".sqlite3-shm", ".db", ".db-wal", ".db-shm", ".tmp", ".swp", "~")


def is_work_path(path: Column) -> Column:
    """A relative path without hidden, generated or parent parts, and without a runtime suffix in any case; null is none."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    bad = F.exists(parts, lambda p: p.isin(*GENERATED_DIRS) | p.startswith("."))
    name = F.lower(F.element_at(parts, -1))
    runtime = F.lit(False)
    for suffix in RUNTIME_SUFFIXES:
        runtime = runtime | name.endswith(suffix)
    return F.coalesce((F.size(parts) > 0) & ~path.startswith("/") & ~bad & ~F.when(F.size(parts) > 0, runtime).otherwise(True), F.lit(False))


def lexical_flags(df: DataFrame, text: str, source: str) -> DataFrame:
    """Flags of a description, and the share of its distinct words that its source text has, in thousandths."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    own, other = words(text), words(source)
    return df.withColumns(
        {
            "unclear": F.coalesce(F.col(text).rlike(UNCLEAR), F.lit(False)),
            "claims_done": F.coalesce(F.col(text).rlike(COMPLETION), F.lit(False)),
            "overlap_permille": F.when(F.size(own) > 0, F.floor(F.size(F.array_intersect(own, other)) * 1000 / F.size(own))),
        }
    )


def supported_topic(topic: Column, word: Column, source: Column) -> Column:
    """Whether a source supports a topic: the evidence word, of four letters or a known short subject, occurs in it, and topic
    and source share a subject. `Unclear` needs no support; null is none."""
    low, clean = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.trim(F.coalesce(word, F.lit(""))))
    named = ((F.length(clean) >= 4) | clean.isin(*SHORT_SUBJECTS)) & F.contains(low, clean)
    shared = F.arrays_overlap(subject_tokens(F.coalesce(topic, F.lit(""))), subject_tokens(low))
    return F.coalesce(F.lower(topic) == "unclear", F.lit(False)) | named & F.coalesce(shared, F.lit(False))


# Domains of examples, and addresses that anyone may know.
EXAMPLE_DOMAINS = ("example.com", "example.org", "example.net", "example.invalid", "example.test", "users.noreply.github.com")
PUBLIC_CONTACTS = ("noreply@github.com",)
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def identifier_pattern(text: str, mode: str) -> str:
    """A private identifier as a pattern: literal as it stands, or a word in any case."""
    if mode not in ("literal", "word") or not 3 <= len(text) <= 1024:
        raise ValueError("an identifier has 3 to 1024 characters and is a literal or a word")
    escaped = re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)
    return escaped if mode == "literal" else f"(?i)(?<![A-Za-z0-9]){escaped}(?![A-Za-z0-9])"


def privacy_flags(text: Column, identifiers: list[tuple[str, str]]) -> dict[str, Column]:
    """What must not be published in a text: home paths, private identifiers, credentials, and contacts that are no example.

    Slashes that JSON escapes count as slashes. identifiers are (text, mode).
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\\/"), F.lit("/"))
    known = F.lit(False)
    for value, mode in identifiers:
        known = known | plain.rlike(identifier_pattern(value, mode))
    own = F.exists(F.regexp_extract_all(F.lower(plain), F.lit(ADDRESS.replace("A-Za-z", "a-z")), F.lit(0)), lambda a: ~F.substring_index(a, "@", -1).isin(*EXAMPLE_DOMAINS) & ~a.isin(*PUBLIC_CONTACTS))
    return {"home_path": plain.rlike(HOME_PATH), "identifier": known, "credential": plain.rlike(CREDENTIAL), "contact": own}


def privacy_scan(df: DataFrame, id_col: str, text_col: str, identifiers: list[tuple[str, str]]) -> DataFrame:
    """Lines with each kind of privacy_flags(): how many, and the first, by text."""
    lines = df.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "s"))
    flags = F.array_compact(F.array(*[F.when(c, k) for k, c in privacy_flags(F.col("s"), identifiers).items()]))
    found = lines.select(id_col, "line", F.explode(flags).alias("kind"))
    return found.groupBy(id_col, "kind").agg(F.count(F.lit(1)).alias("lines"), (F.min("line") + 1).cast("long").alias("first_line"))


def publishable(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A text with its private identifiers (text, mode, replacement) replaced; null where something private is left over."""
    out = text
    for value, mode, to in rules:
        out = F.regexp_replace(out, identifier_pattern(value, mode), to.replace("\\", "\\\\").replace("$", "\\$"))
    flags = privacy_flags(out, [(v, m) for v, m, _ in rules])
    return F.when(~(flags["home_path"] | flags["contact"] | flags["identifier"]), out)


def line_scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with home paths, credentials, e-mail or phone numbers: count and first line of each kind by text."""
    lines = df.select(F.col(id_col), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "s"))
    kinds = {"home_path": HOME_PATH, "credential": CREDENTIAL, "email": EMAIL, "phone": PHONE}
    found = lines.select(id_col, "line", F.explode(F.array_compact(F.array(*[F.when(F.col("s").rlike(p), k) for k, p in kinds.items()]))).alias("kind"))
    return found.groupBy(id_col, "kind").agg(F.count(F.lit(1)).alias("lines"), (F.min("line") + 1).cast("long").alias("first_line"))


def redact_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Replacement rules one after another; patterns are regular expressions."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def measured(x: Column) -> Column:
    """A number that is finite and not negative, else null."""
    return F.when(~(F.isnan(x) | (x < 0) | (x == float("inf"))), x)


def heat_level(seconds: Column) -> Column:
    """Five levels of intensity."""
    return F.when(seconds.isNull(), None).when(seconds <= 0, 0).when(seconds < 900, 1).when(seconds < 1800, 2).when(seconds < 2700, 3).otherwise(4).cast("long")


def coarse_state(locked: Column, idle_seconds: Column) -> Column:
    return F.when(locked, "locked").when(idle_seconds >= 180, "idle").otherwise("window")


def engine_timings(df: DataFrame, text: str) -> DataFrame:
    """Prompt and generation time and tokens out of a log text, and tokens a second; null where a line is missing."""
    number = lambda p: F.expr(f"try_cast(regexp_extract({text}, '{p}', 1) AS DOUBLE)")
    told = df.withColumns({"prompt_ms": number(r"prompt eval time = *([0-9.]+) ms"), "eval_ms": number(r"(?m)^eval time = *([0-9.]+) ms"), "eval_tokens": number(r"(?m)^eval time = *[0-9.]+ ms / *([0-9]+)")})
    return told.withColumn("tokens_per_s", F.try_divide(F.col("eval_tokens") * 1000, F.col("eval_ms")))


def engine_report(df: DataFrame, text: str) -> DataFrame:
    """What an engine's log tells, of several such lines the last: seconds to load, to read the prompt and to generate, the
    tokens of both, seconds to encode an image, and generated tokens a second; null where the log does not say."""

    def last(pattern: str, group: int, which: int = 1) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
        return F.when(F.size(found) > 0, F.element_at(found, which))

    line = r"(?m)^[^\n=]*?(?<!prompt )\b{} *= *([0-9.]+) *ms(?: */ *([0-9]+) *(?:tokens|runs))?"
    number = lambda c: c.try_cast("double")
    told = {}
    for label, seconds, tokens in (("load time", "load_s", None), ("prompt eval time", "prompt_s", "prompt_tokens"), ("eval time", "generation_s", "generated_tokens")):
        told[seconds] = number(last(line.format(label), 1, -1)) / 1000
        if tokens:
            told[tokens] = F.when(last(line.format(label), 2, -1) != "", last(line.format(label), 2, -1)).cast("long")
    told["encode_s"] = number(last(r"(?i)(?:encode_image|image encoding|image encoded)[^\n]*?([0-9.]+) *ms", 1)) / 1000
    out = df.withColumns(told)
    return out.withColumn("tokens_per_s", F.when(F.col("generation_s") > 0, F.col("generated_tokens") / F.col("generation_s")))
