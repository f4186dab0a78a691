"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full(c: Column) -> Column:
    """Null where ``c`` is null or blank."""
    return F.when(F.trim(c) != "", c)


def display_name(name: Column, user_name: Column, user_id: Column) -> Column:
    """The name, else the user name, else ``user_<id>``; blanks count as missing."""
    return F.coalesce(full(name), full(user_name), F.concat(F.lit("user_"), user_id.cast("string")))


def render_post(threshold: int) -> Column:
    """The feed text of a post from kind, who, content, quote_content, root_who, root_content and num_reports."""
    q = lambda c: F.coalesce(F.col(c), F.lit("?"))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    repost = F.concat(q("who"), F.lit(" reposted a post from "), q("root_who"), F.lit(". Repost content: "), e("root_content"), F.lit("."))
    quote = F.concat(q("who"), F.lit(" quoted a post from "), q("root_who"), F.lit(". Quote content: "), F.col("quote_content"), F.lit(". Original Content: "), e("root_content"))
    body = F.when(F.col("kind") == "repost", repost).when(F.col("kind") == "quote", quote).otherwise(e("content"))
    warning = F.concat(F.lit("[Warning: This post has been reported "), F.col("num_reports").cast("string"), F.lit(" times]\n"))
    return F.concat(F.when(F.col("num_reports") >= threshold, warning).otherwise(F.lit("")), body)


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def shorten(c: Column, n: int = 500) -> Column:
    """``c`` squeezed and cut to ``n`` characters, the last three of them dots."""
    s = squeeze(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 3), F.lit("..."))).otherwise(s)


def preview(c: Column, n: int) -> Column:
    """The first ``n`` characters, with dots if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def plain_punctuation(c: Column) -> Column:
    """Curly quotes and long dashes as ASCII, runs of ``!`` as one, white space squeezed."""
    t = F.translate(c, "’‘“”—–", "''\"\"--")
    return squeeze(F.regexp_replace(t, "!{2,}", "!"))


def ascii_words(c: Column) -> Column:
    """ASCII only, words joined by single blanks."""
    return squeeze(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


#: Patterns of text that was never filled in (fixed values).
ISSUES = {
    "unimputed_label_token": r"#?LBL:\s*[A-Z_]+",
    "bracketed_label_token": r"<LBL:",
    "json_markdown_block": r"```",
    "replacement_placeholder": r"\{\"replacement\":",
}

#: Replacements of the strip mode, in order (fixed values).
STRIPS = [
    (r"\s*#?LBL:\s*[A-Z_]+[^.!?\s]*", ""),
    (r"\s*LBL:[A-Z_]+\s*", ""),
    (r"\s*<LBL:[A-Z_]+>\s*", ""),
    (r"\s*\[LBL:[A-Z_]+\]\s*", ""),
    (r"\s*```json\s*", ""),
    (r"\s*```\s*", ""),
    (r"\s*\{\"replacement\":\s*\"[^\"]*\"\}\s*", ""),
    (r"\s*\{\"replacement\":[^}]+\}\s*", ""),
    (r"\s+$", ""),
    (r"^\s+", ""),
    (r"\s{2,}", " "),
]


def issues(c: Column) -> Column:
    """Names of the issues found in ``c``."""
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in ISSUES.items()]), lambda x: x.isNotNull())


def strip_leftovers(c: Column) -> Column:
    """``c`` after all replacements of the strip mode."""
    for pattern, to in STRIPS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def label_tokens(c: Column) -> Column:
    """Label tokens of ``c`` in order, as ``LBL:NAME``, with or without angle brackets."""
    found = F.regexp_extract_all(c, F.lit(r"(<LBL:[A-Z0-9_]+>|(?<!<)LBL:[A-Z0-9_]+(?!>))"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, "[<>]", ""))


#: Bracketed tags that are dropped (fixed values).
DROPPED_TAGS = [
    r"\[Style[:\s][^\]]*\]",
    r"\[CTA[:\s][^\]]*\]",
    r"\[Author[^\]]*\]",
    r"\[Post ID[^\]]*\]",
    r"\[Time[:\s][^\]]*\]",
    r"\[Framework[:\s][^\]]*\]",
    r"\[Case Study[^\]]*\]",
    r"\[Dashboard[^\]]*\]",
    r"\[chunk \d+/\d+[^\]]*\]",
    r"\[REDACTED\]",
]


def clean_brackets(c: Column) -> Column:
    """Known tags removed; of the other brackets short ones dropped, long ones unwrapped; squeezed."""
    for p in DROPPED_TAGS:
        c = F.regexp_replace(c, "(?i)" + p, "")
    c = F.regexp_replace(c, r"\[[^\]\[]{0,19}\]", "")
    return squeeze(F.regexp_replace(c, r"\[([^\]\[]{20,})\]", "$1"))


def escape_html(c: Column) -> Column:
    """The five special characters as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def keyword_words(c: Column) -> Column:
    """Lower-case words of more than three letters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1)), lambda w: F.length(w) > 3)


def append_missing(c: Column, tokens: Column) -> Column:
    """``c`` with the tokens it does not contain appended."""
    return F.concat_ws(" ", F.nullif(F.trim(c), F.lit("")), F.array_join(F.filter(tokens, lambda t: ~F.contains(c, t)), " "))


def persona_prefix(c: Column, prefixes: list[str]) -> Column:
    """The first of ``prefixes`` that begins ``c`` before an underscore."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.startswith(p + "_"), F.lit(p)) for p in prefixes])


def enforced(text: Column, tokens: Column) -> Column:
    """A text without any label token, and the given ``tokens`` (an array) appended once; unchanged at its end where there are none."""
    bare = F.regexp_replace(F.regexp_replace(text, "<LBL:([A-Z_]+)>", r" LBL:\$1"), "</LBL:[A-Z_]+>", "")
    none = F.regexp_replace(bare, r"LBL:[A-Z_$0-9]+", "")
    return F.when(F.size(tokens) == 0, none).otherwise(F.concat(F.rtrim(none), F.lit(" "), F.array_join(tokens, " ")))
