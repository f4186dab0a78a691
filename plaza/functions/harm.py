"""Pattern detectors of harmful text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and the categories they stand for (fixed values).
PATTERNS = [
    (r"(?:thinspo|meanspo|ana\s*buddy|pro[\s-]*ana|mia|purge|restrict|fast(?:ing)?.*goal|goal\s*weight|ugw|gw|cw|hw)", ["ed_risk", "pro_ana"]),
    (r"(?:calorie|kcal|bmi|body\s*check|scale|weigh)", ["ed_risk"]),
    (r"(?:blackpill|redpill|chad|stacy|foid|femoid|roastie|hypergamy|smv|lookism|looksmax|gymcel|incel)", ["incel_misogyny"]),
    (r"(?:alpha|beta|sigma|frame|plate|spinning|high\s*value)", ["alpha"]),
    (r"(?:wake\s*up|sheeple|msm|mainstream\s*media|they\s*don't\s*want|suppressed|hidden\s*truth|do\s*your\s*research)", ["misinfo", "conspiracy"]),
    (r"(?:deep\s*state|false\s*flag|controlled\s*opposition|psyop|cover[\s-]*up)", ["conspiracy"]),
    (r"(?:race\s*war|boogaloo|accelerat|day\s*of\s*the\s*rope|1488|14\s*words)", ["extremist"]),
    (r"(?:replacement|invasion|great\s*replacement|white\s*genocide)", ["hate_speech", "extremist"]),
    (r"(?:kys|kill\s*yourself|neck\s*yourself|rope|sui|end\s*it)", ["bullying", "extremist"]),
    (r"(?:doxx|expose|screenshot.*shame|pile\s*on)", ["bullying"]),
    (r"(?:woke|sjw|forced\s*diversity|go\s*woke|get\s*woke)", ["gamergate"]),
    (r"(?:trad\s*wife|tradwife|natural\s*order|decline|degeneracy)", ["trad"]),
]
#: Categories of the second detector and their patterns, of any case (fixed values).
SECOND = {
    "ed_risk": [r"thinspo", r"meanspo", r"pro[\s-]*ana", r"goal\s*weight", r"ugw", r"restrict", r"calorie", r"bmi", r"body\s*check", r"fast(?:ing)"],
    "incel_misogyny": [r"blackpill", r"redpill", r"chad", r"stacy", r"foid", r"incel", r"hypergamy"],
    "bullying": [r"kys", r"kill\s*yourself", r"rope", r"doxx", r"expose"],
    "extremist": [r"race\s*war", r"boogaloo", r"1488", r"day\s*of\s*the"],
    "hate_speech": [r"replacement", r"white\s*genocide", r"invasion"],
    "misinfo": [r"wake\s*up", r"sheeple", r"msm", r"suppressed", r"do\s*your\s*research"],
    "conspiracy": [r"deep\s*state", r"false\s*flag", r"cover[\s-]*up", r"psyop"],
}
#: Severity and action of the categories (fixed values).
SEVERITY = {
    "benign": (0, "none"),
    "recovery_support": (0, "none"),
    "ed_risk": (3, "flag"),
    "pro_ana": (4, "intervene"),
    "incel_misogyny": (3, "flag"),
    "alpha": (2, "flag"),
    "misinfo": (2, "flag"),
    "conspiracy": (2, "flag"),
    "trad": (1, "monitor"),
    "gamergate": (2, "flag"),
    "extremist": (5, "intervene"),
    "hate_speech": (5, "intervene"),
    "bullying": (4, "intervene"),
}
ACTIONS = ["none", "monitor", "flag", "intervene"]
#: Indicators of explicit and of implicit hostility (fixed values).
EXPLICIT = ["hate", "kill", "destroy", "inferior", "subhuman"]
IMPLICIT = ["we need to", "our country", "these people", "them", "they"]


def counts(c: Column) -> Column:
    """Number of matches of each pattern, of any case, in one array: the only look at the text."""
    return F.array(*[F.regexp_count(c, F.lit("(?i)" + p)) for p, _ in PATTERNS])


def matches(found: Column) -> Column:
    """Number of all matches, given ``counts``."""
    return F.aggregate(found, F.lit(0), lambda a, x: a + x)


def categories(found: Column) -> Column:
    """Sorted categories of the patterns with matches, given ``counts``; ``benign`` where there are none."""
    own = [F.when(found[i] > 0, F.array(*[F.lit(x) for x in cats])).otherwise(F.array().cast("array<string>")) for i, (_, cats) in enumerate(PATTERNS)]
    every = F.flatten(F.array(*own))
    return F.when(F.size(every) > 0, F.array_sort(F.array_distinct(every))).otherwise(F.array(F.lit("benign")))


def second_categories(c: Column) -> Column:
    """Categories of SECOND of which a pattern occurs, in their order; ``benign`` where there are none."""
    hits = F.array(*[F.when(c.rlike("(?i)" + "|".join(ps)), F.lit(k)) for k, ps in SECOND.items()])
    found = F.filter(hits, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("benign")))


def n_words(c: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def confidence(n: Column, words: Column) -> Column:
    """By density of the ``n`` matches; 0.8 where there are none."""
    return F.when(n == 0, 0.8).otherwise(F.least(F.lit(0.9), 0.3 + F.try_divide(n, words) * 2))


def severity(cats: Column) -> Column:
    """The greatest severity of the categories."""
    known = F.create_map(*[x for k, (s, _) in SEVERITY.items() for x in (F.lit(k), F.lit(s))])
    return F.array_max(F.transform(cats, lambda x: F.coalesce(known[x], F.lit(0))))


def action(cats: Column) -> Column:
    """The strongest action of the categories."""
    rank = F.create_map(*[x for k, (_, a) in SEVERITY.items() for x in (F.lit(k), F.lit(ACTIONS.index(a)))])
    return F.get(F.array(*[F.lit(a) for a in ACTIONS]), F.array_max(F.transform(cats, lambda x: F.coalesce(rank[x], F.lit(0)))))


def spectrum(c: Column) -> Column:
    """``explicit_hate``, ``implicit_hate``, ``neutral`` or ``unknown`` by counts of indicators."""
    count = lambda xs: F.size(F.filter(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(F.lower(c), x)))
    e, i = count(EXPLICIT), count(IMPLICIT)
    return F.when(e > 2, "explicit_hate").when((i > 2) & (e < 2), "implicit_hate").when((e == 0) & (i < 2), "neutral").otherwise("unknown")
