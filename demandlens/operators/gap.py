"""Skill-gap matching as a batch over a profiles table.

The reference validates one user's comma-separated input per call and
compares it with the trending list. Here every profile row is handled by the
same column expressions (split, filter, transform, exists), so a table of
millions of profiles is one map-only pass. The trending list (top-n, a
bounded array) and the best association rule per antecedent (bounded by the
itemsets) are the only other inputs; the trending list is attached as a
scalar subquery, the rules through an equi-join on the antecedent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import strip_text
from demandlens.operators.trends import PRIMARY_TREND_SKILLS, TREND_TOP_N, trending_score

# Trivial inputs, alias map, names kept lower-case, the
# keyword shape required of long phrases, and the messages.
TRIVIAL_INPUTS = ["", "n/a", "na", "none", "null", "asdfghjkl", "qwerty", "i know everything"]
EVERYTHING_PHRASES = ["i know everything", "i know all"]
COMMON_SKILL_ALIASES = {
    "scikit learn": "scikit-learn",
    "sklearn": "scikit-learn",
    "power bi": "power bi",
    "excel": "excel",
    "powerpoint": "powerpoint",
    "cuda": "cuda",
    "tensorflow": "tensorflow",
    "pytorch": "pytorch",
    "python": "python",
    "sql": "sql",
    "pandas": "pandas",
}
LOWER_CASE_SKILLS = [
    "aws", "gcp", "sql", "nlp", "llm", "rag", "cuda", "python", "pandas", "azure",
    "tensorflow", "pytorch", "computer vision", "scikit-learn",
]
LONG_PHRASE_WORDS = 5
LONG_PHRASE_KEYWORDS = "(?i)(python|sql|excel|power|data|cloud|ml|ai|tableau|pandas|tensorflow|pytorch|azure|aws|gcp)"
MSG_EMPTY = "Please enter at least one skill, for example: Python, SQL, Tableau."
MSG_TRIVIAL = "Please enter at least one recognizable skill, for example: Python, SQL, Tableau."
MSG_NONE_VALID = "No recognizable skills found. Please enter skills like: Python, SQL, Tableau."
ADVICE_NO_SKILLS = "Please enter at least one skill so I can assess your gap."
ADVICE_NO_OVERLAP = ("Your profile does not overlap with the current trending stack yet. Start with {start}, "
                     "then add Python and SQL as a foundation for data workflows.")
ADVICE_COVERED = ("You already cover most of the current trend stack. Next, deepen your portfolio with "
                  "project work, deployment practice, and interview-ready case studies.")
ADVICE_GAPS = ("You already have {have}. The biggest gaps are {gaps}. Prioritize the missing cloud and ML "
               "tools first, then practice one end-to-end project that combines data prep, modeling, and "
               "deployment.")
INSIGHT = "Association insight: Jobs requiring {ante} also require {cons} with {pct}% confidence."
PROMPT_LONG = ("My current skills are: {user}.\nTop trending skills in 2024-2026 are: {trending}.\n"
               "Identify my skill gaps and explain concisely what I should prioritize learning.\n"
               "Focus on these priority gaps first: {priority}.")
PROMPT_CONCISE = ("My current skills are: {user}.\nTop trending skills are: {trending}.\n"
                  "Tell me my main gaps and what to learn next in 3-5 short bullets.")
PRIORITY_FALLBACK = "the most relevant trending skills"
PRIORITY_N = 5


def _strip(c: Column) -> Column:
    return strip_text(c)


def _once(c: Column) -> Column:
    """A generator of one row: its column is computed once a row, where an expression
    would be put into whatever reads it, and run again for each array element there."""
    return F.explode(F.array(c))


def _in_list(c: Column, values: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), c)


def valid_phrase(token: Column) -> Column:
    """A token is a skill phrase when it is not trivial, has >= 2
    characters and a letter, and -- beyond 5 words -- names a known keyword."""
    t = _strip(token)
    return _valid(t, F.lower(t))


def _valid(t: Column, low: Column) -> Column:
    """``valid_phrase`` of a stripped token and its lower-case form."""
    words = F.size(F.split(t, r"\s+"))
    return ((t != "") & ~_in_list(low, TRIVIAL_INPUTS) & (F.length(t) >= 2)
            & t.rlike("[a-zA-Z]") & ~_in_list(low, EVERYTHING_PHRASES)
            & ((words <= LONG_PHRASE_WORDS) | t.rlike(LONG_PHRASE_KEYWORDS)))


def canonical_skill(token: Column) -> Column:
    """Collapse inner whitespace; alias map; known names lower-cased;
    anything else keeps its case."""
    cleaned = _spaced(token)
    return _canonical(cleaned, F.lower(cleaned))


def _spaced(token: Column) -> Column:
    return F.regexp_replace(_strip(token), r"\s+", " ")


def _canonical(cleaned: Column, low: Column) -> Column:
    """``canonical_skill`` of a token with single spaces and its lower-case form."""
    pairs = []
    for k, v in COMMON_SKILL_ALIASES.items():
        pairs += [F.lit(k), F.lit(v)]
    alias = F.element_at(F.create_map(*pairs), low)
    return F.coalesce(alias, F.when(_in_list(low, LOWER_CASE_SKILLS), low), cleaned)


def parse_profiles(profiles: DataFrame, text: str = "skills_text") -> DataFrame:
    """Validate each profile's comma-separated text, whatever its length.

    Adds ``valid`` (bool), ``message`` (null when valid) and ``user_skills``
    (canonical skills, first occurrence order, duplicates removed).
    """
    def both(x: Column) -> Column:  # a lambda computes again whatever it names twice
        return F.struct(x.alias("t"), F.lower(x).alias("low"))

    rows = profiles.select("*", _once(_strip(F.col(text))).alias("_raw"))
    split = F.filter(F.transform(F.split("_raw", ","), lambda x: _strip(x)), lambda x: x != "")
    rows = rows.select("*", _once(F.transform(split, both)).alias("_tokens"))
    kept = F.transform(F.filter("_tokens", lambda x: _valid(x["t"], x["low"])), lambda x: _spaced(x["t"]))
    unique = F.array_distinct(F.transform(F.transform(kept, both), lambda x: _canonical(x["t"], x["low"])))
    rows = rows.select("*", _once(unique).alias("_cleaned"))
    raw, tokens, cleaned = F.col("_raw"), F.col("_tokens"), F.col("_cleaned")
    trivial = (raw == "") | _in_list(F.lower(raw), TRIVIAL_INPUTS) | (F.size(tokens) == 0)
    message = (F.when(F.col(text).isNull(), F.lit(MSG_EMPTY))
                .when(trivial, F.lit(MSG_TRIVIAL))
                .when(F.size(cleaned) == 0, F.lit(MSG_NONE_VALID)))
    return (rows.withColumn("message", message)
                .withColumn("valid", F.col("message").isNull())
                .withColumn("user_skills", F.when(F.col("valid"), cleaned)).drop("_raw", "_tokens", "_cleaned"))


def trending_list(df: DataFrame, top_n: int = TREND_TOP_N, weight: str | None = None) -> Column:
    """The top-n trending skills (A16) as one array, in rank order; a scalar
    subquery over at most top_n rows."""
    ranked = trending_score(df, top_n, weight=weight)
    # canonical names (lower-case, as trending names are) computed once, inside
    # the subquery, so the per-profile expressions only read the finished list;
    # an empty input gives the fixed fallback list
    fallback = F.array(*[F.lit(x) for x in PRIMARY_TREND_SKILLS[:top_n]])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "skill"))),
                         lambda x: F.lower(canonical_skill(x["skill"])))
    return ranked.agg(F.when(F.size(listed) > 0, listed).otherwise(fallback)).scalar()


def _match(x: Column, y: Column) -> Column:
    """Names under 3 characters must be equal, longer ones may also
    contain one another. Both are stripped, lower-case names."""
    short = (F.length(x) < 3) | (F.length(y) < 3)
    return F.when(short, x == y).otherwise((x == y) | x.contains(y) | y.contains(x))


def skill_gap(parsed: DataFrame, trending: Column) -> DataFrame:
    """Matched user skills, missing trending skills (by exact
    lower-case name, so a partial match still leaves the trending skill
    missing) and the first five as priority.

    ``trending`` is the canonical, lower-case trending list (``trending_list``).
    Every lambda below reads only its own variables and that list: a lambda
    that referenced another derived column would get that column's whole
    expression inlined by the optimizer and re-run per array element.
    """
    # a subquery may not sit inside a higher-order function: hold it in a column
    df = parsed.withColumn("_trending", trending)
    df = df.select("*", _once(F.transform("_trending", lambda t: F.lower(_strip(t)))).alias("_names"))
    named = F.transform("user_skills", lambda u: F.struct(u.alias("u"), F.lower(_strip(u)).alias("x")))
    matched = F.transform(F.filter(named, lambda k: F.exists(F.col("_names"), lambda y: _match(k["x"], y))), lambda k: k["u"])
    df = df.select("*", _once(matched).alias("matched_skills")).drop("_names")
    # a filter, not array_except: a name that the list holds twice stays twice
    df = df.withColumn("_lower", F.transform(F.col("matched_skills"), lambda m: F.lower(m)))
    missing = F.when(F.col("_lower").isNotNull(),  # an invalid profile has no lists
                     F.filter(F.col("_trending"), lambda t: ~F.array_contains(F.col("_lower"), F.lower(t))))
    return (df.withColumn("missing_skills", missing)
              .withColumn("priority_skills", F.slice(F.col("missing_skills"), 1, PRIORITY_N))
              .withColumn("trending_skills", F.when(F.col("valid"), F.col("_trending")))
              .drop("_trending", "_lower"))


def _join(c: Column) -> Column:
    return F.array_join(c, ", ")


def offline_advice() -> Column:
    """The deterministic advice text (four cases)."""
    user, matched = F.col("user_skills"), F.col("matched_skills")
    priority, trending = F.col("priority_skills"), F.col("trending_skills")
    start = F.when(F.size(priority) > 0, _join(F.slice(priority, 1, 3))).otherwise(_join(F.slice(trending, 1, 3)))
    pre, post = ADVICE_NO_OVERLAP.split("{start}")
    have_pre, rest = ADVICE_GAPS.split("{have}")
    mid, tail = rest.split("{gaps}")
    return (F.when(F.size(user) == 0, F.lit(ADVICE_NO_SKILLS))
             .when(F.size(matched) == 0, F.concat(F.lit(pre), start, F.lit(post)))
             .when(F.size(F.slice(priority, 1, 4)) == 0, F.lit(ADVICE_COVERED))
             .otherwise(F.concat(F.lit(have_pre), _join(F.slice(matched, 1, 3)), F.lit(mid),
                                 _join(F.slice(priority, 1, 4)), F.lit(tail))))


def prompts() -> tuple[Column, Column]:
    """The long and concise prompt texts (built as data, never sent)."""
    user, trending, priority = _join(F.col("user_skills")), _join(F.col("trending_skills")), F.col("priority_skills")
    pr = F.when(F.size(priority) > 0, _join(priority)).otherwise(F.lit(PRIORITY_FALLBACK))
    long_parts = PROMPT_LONG.replace("{user}", "\x00").replace("{trending}", "\x00").replace("{priority}", "\x00").split("\x00")
    short_parts = PROMPT_CONCISE.replace("{user}", "\x00").replace("{trending}", "\x00").split("\x00")
    long_p = F.concat(F.lit(long_parts[0]), user, F.lit(long_parts[1]), trending, F.lit(long_parts[2]), pr,
                      F.lit(long_parts[3]))
    short_p = F.concat(F.lit(short_parts[0]), user, F.lit(short_parts[1]), trending, F.lit(short_parts[2]))
    return long_p, short_p


def best_rule_per_antecedent(rules: DataFrame) -> DataFrame:
    """G7 helper: per lower-cased antecedent text, its highest-lift rule
    (ties by the rule text). One row per distinct antecedent."""
    key = F.lower(_strip(F.col("antecedents")))
    order = F.struct(-F.col("lift"), F.col("antecedents"), F.col("consequents"))
    return (rules.groupBy(key.alias("ante_key"))
                 .agg(F.min_by(F.struct("antecedents", "consequents", "confidence", "lift"), order).alias("r")))


def rule_insight(gap: DataFrame, rules: DataFrame, key: str = "user_id") -> DataFrame:
    """For each profile, the highest-lift rule whose antecedent equals
    one of the user's skills (lower-cased), as the insight sentence with the
    confidence in whole percent, halves to the even one. Profiles without such
    a rule get null."""
    best = best_rule_per_antecedent(rules)
    skills = gap.select(key, F.explode(F.col("user_skills")).alias("u")).select(
        key, F.lower(_strip(F.col("u"))).alias("ante_key"))
    hits = (skills.join(best, "ante_key")
                  .groupBy(key)
                  .agg(F.min_by(F.col("r"), F.struct(-F.col("r.lift"), F.col("r.antecedents"),
                                                     F.col("r.consequents"))).alias("r")))
    pre, rest = INSIGHT.split("{ante}")
    mid1, rest = rest.split("{cons}")
    mid2, tail = rest.split("{pct}")
    text = F.concat(F.lit(pre), F.col("r.antecedents"), F.lit(mid1), F.col("r.consequents"), F.lit(mid2),
                    F.bround(F.col("r.confidence") * 100, 0).cast("bigint").cast("string"), F.lit(tail))
    return gap.join(hits.select(key, text.alias("insight")), key, "left")


def preview(gap_with_insight: DataFrame) -> DataFrame:
    """Advice text, followed by the rule insight when there is one."""
    advice = offline_advice()
    full = F.when(F.col("insight").isNotNull(), F.concat(advice, F.lit("\n\n"), F.col("insight"))).otherwise(advice)
    long_p, short_p = prompts()
    return gap_with_insight.select(
        "user_id", "valid",
        F.when(F.col("valid"), full).otherwise(F.col("message")).alias("advice"),
        "insight",
        F.when(F.col("valid"), long_p).alias("prompt_long"),
        F.when(F.col("valid"), short_p).alias("prompt_concise"),
    )
