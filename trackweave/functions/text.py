"""Names, paths and rule tables over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Severity, name and pattern of the text scan, in the common subset of regular-expression dialects.
SCAN_RULES = [
    ("CRITICAL", "windows_user_path", r"(?i)C:\\Users\\"),
    ("CRITICAL", "workspace_absolute_path", r"(?i)C:\\Workspaces"),
    ("CRITICAL", "env_file_reference", r"(?i)(^|[\\/])\.env($|[\s`'\"])"),
    ("CRITICAL", "openai_api_key", r"(?i)OPENAI_API_KEY"),
    ("CRITICAL", "anthropic_api_key", r"(?i)ANTHROPIC_API_KEY"),
    ("CRITICAL", "google_api_key", r"(?i)GOOGLE_API_KEY"),
    ("HIGH", "secret_word", r"(?i)\bSECRET\b"),
    ("HIGH", "token_word", r"(?i)\bTOKEN\b"),
    ("CRITICAL", "absolute_video_path", r"(?i)[A-Z]:\\[^:\n]+?\.(mp4|mov|avi|mkv|webm|m4v)"),
    ("CRITICAL", "private_content_pack_reference", r"(?i)content_pack"),
    ("CRITICAL", "private_publisher_pack_reference", r"(?i)publisher_pack"),
    ("HIGH", "tiktok_reference", r"(?i)TikTok"),
    ("HIGH", "youtube_tags_reference", r"(?i)YouTube tags"),
]
#: Rules of our own beside them: what the driver's documents hold.
DOCUMENT_RULES = [
    ("CRITICAL", "email_address", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z]+"),
    ("HIGH", "license_word", r"(?i)\blicense\b"),
]
#: The scan of a packed release.
PACKAGE_RULES = [
    ("CRITICAL", "windows_user_path", r"(?i)C:\\Users\\"),
    ("CRITICAL", "workspace_absolute_path", r"(?i)C:\\Workspaces"),
    ("CRITICAL", "env_file_reference", r"(?i)(^|[\\/])\.env($|[\s`'\"])"),
    ("CRITICAL", "openai_api_key", r"(?i)OPENAI_API_KEY"),
    ("CRITICAL", "anthropic_api_key", r"(?i)ANTHROPIC_API_KEY"),
    ("CRITICAL", "google_api_key", r"(?i)GOOGLE_API_KEY"),
    ("CRITICAL", "private_data_dir", r"(?i)data[\\/](cases|outputs|reports|content_packs|publisher_packs)"),
    ("CRITICAL", "private_content_pack", r"(?i)content pack|content_pack"),
    ("CRITICAL", "private_publisher_pack", r"(?i)publisher pack|publisher_pack"),
    ("CRITICAL", "original_video", r"(?i)\.(mp4|mov|avi|mkv|webm|m4v)\b"),
]
#: What a public text must not hold.
PLACEHOLDERS = [
    r"(?i)\[EDIT",
    r"(?i)\[EDITAR",
    r"(?i)<SOURCE",
    r"(?i)C:\\Users\\",
    r"(?i)\\runtime\\",
    r"(?i)C:\\Workspaces",
    r"(?i)resolution:\s*`\{\}`",
    r"(?i)filename:\s*`unknown`",
    r"(?i)duration:\s*`not available",
    r"(?i)FPS:\s*`not available",
    r"(?i)source path",
]


def placeholders(text: Column, patterns: list[str] = PLACEHOLDERS) -> Column:
    """Numbers of the patterns that a text breaks, from 0; empty for a text that may be shown."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)]))


def case_label(case: Column, file: Column) -> Column:
    """The release number of a case or file name, as DOD_n, else the case."""
    found = F.regexp_extract(F.concat_ws(" ", case, file), r"(?:DOD|dod)[_\- ]?([0-9]+)", 1)
    return F.when(found != "", F.concat(F.lit("DOD_"), found)).otherwise(case)


#: Local stamps of records and of batch names.
STAMPS = {"record": "yyyy-MM-dd'T'HH:mm:ss", "batch": "yyyyMMdd_HHmmss"}


def stamp(ts: Column, kind: str) -> Column:
    return F.date_format(ts, STAMPS[kind])


def slug(name: Column, default: str = "case", longest: int | None = None) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    if longest:
        cleaned = F.substring(cleaned, 1, longest)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def unique_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds ``unique_id``: the slug, and from its second row on, in ``order``, a suffix _02, _03 ..."""
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    return df.withColumn("slug", slug(F.col(name))).withColumn("at", at).withColumn("unique_id", F.when(F.col("at") == 1, F.col("slug")).otherwise(F.concat("slug", F.format_string("_%02d", "at")))).drop("at")


def scan(lines: DataFrame, rules=(*SCAN_RULES, *DOCUMENT_RULES), allowed: Column | None = None) -> DataFrame:
    """(…, severity, rule) for every rule a line breaks: one pass, the rule table folded into the expression."""
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for s, n, p in rules]))
    rows = lines if allowed is None else lines.where(~allowed)
    return rows.withColumn("hit", F.explode(hits)).select(*lines.columns, "hit.severity", "hit.rule")


def public_path(path: Column) -> Column:
    """Private absolute paths are cut to their last part; other text stays."""
    slashed = F.translate(path, "/", "\\")
    private = slashed.contains("C:\\Users\\") | slashed.contains("C:\\Workspaces\\") | slashed.contains("\\runtime\\")
    return F.when(private, F.coalesce(F.nullif(F.element_at(F.split(slashed, r"\\"), -1), F.lit("")), F.lit("redacted for public report"))).otherwise(path)


def source_quality(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("youtube") | low.contains("yt-") | low.contains("reddit"), "secondary_copy").otherwise("unknown")


#: Terms of the path classes.
LIGHT_TERMS = ["debug_zscore", "central_brightness", "brightness", "auto_current", "max_projection"]
ENTITY_TERMS = ["manual_center", "base", "pca", "motion", "optical_flow", "mean_projection"]


def path_class(path: Column, light: list[str] = LIGHT_TERMS, entity: list[str] = ENTITY_TERMS) -> Column:
    low = F.lower(path)
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    return F.when(has(light) & has(entity), "mixed").when(has(light), "light").when(has(entity), "entity").otherwise("unknown")


def frame_number(name: Column) -> Column:
    found = F.regexp_extract(name, r"(?:frame|crop)_([0-9]+)", 1)
    return F.nullif(found, F.lit("")).cast("long")


def first_document(text: Column) -> Column:
    """The last line that is a JSON object, as a variant; null without one."""
    return F.try_parse_json(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x.startswith("{")), F.lit(-1)))
