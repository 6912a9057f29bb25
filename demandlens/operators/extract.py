"""Taxonomy-driven skill extraction from free text.

Each taxonomy entry is one case-insensitive, whole-phrase search evaluated by the
JVM on the whole folded text; the hits are collected into an array per row, so extraction is a map-only pass with no Python
worker. Joins with the taxonomy are plain ones; AQE broadcasts it where it is small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.functions.text import NON_WORD, WORD_CHAR, escape_regex, fold, folded

# The skill taxonomy of the extraction contract.
DEFAULT_TAXONOMY: dict[str, list[str]] = {
    "Languages": ["Python", "SQL", "R", "Java", "Scala", "Julia", "TypeScript"],
    "ML_AI": [
        "Machine Learning", "Deep Learning", "NLP", "Computer Vision",
        "LLM", "RAG", "Prompt Engineering", "TensorFlow", "PyTorch",
        "scikit-learn", "XGBoost", "Random Forest", "Gradient Boosting",
    ],
    "Data_Tools": ["Pandas", "NumPy", "Spark", "dbt", "Airflow", "Kafka"],
    "Visualization": ["Tableau", "Power BI", "Matplotlib", "Plotly", "Seaborn", "Looker"],
    "Cloud": ["AWS", "GCP", "Azure", "Databricks", "Snowflake", "BigQuery"],
    "DevOps_MLOps": ["Docker", "Git", "FastAPI", "MLflow", "Kubernetes", "CI/CD"],
    "General": ["Excel", "Statistics", "A/B Testing", "Hypothesis Testing",
                "Data Storytelling", "Communication"],
}
UNKNOWN_CATEGORY = "Unknown"


def flatten_taxonomy(taxonomy: Mapping[str, Sequence[str]] = DEFAULT_TAXONOMY) -> list[tuple[str, str]]:
    """(category, skill) pairs, longest skill name first (then by name)."""
    pairs = [(cat, s) for cat, skills in taxonomy.items() for s in skills]
    return sorted(pairs, key=lambda p: (-len(p[1]), p[1]))


def taxonomy_frame(spark: SparkSession, taxonomy: Mapping[str, Sequence[str]] = DEFAULT_TAXONOMY) -> DataFrame:
    """The flattened taxonomy as a (category, skill) DataFrame."""
    return spark.createDataFrame(flatten_taxonomy(taxonomy), "category string, skill string")


def phrase_pattern(skill: str, word: bool = True, java: bool = True) -> str:
    """Whole-phrase, case-insensitive pattern for one skill. A word boundary is
    any character that is not a Unicode letter, digit or underscore, or the
    text edge, so 'R' never matches inside 'Regression'."""
    flags = "(?iu)" if java else "(?i)"
    body = escape_regex(skill)
    if not word:
        return f"{flags}{body}"
    return f"{flags}(^|{NON_WORD}){body}({NON_WORD}|$)"


def _whole(phrase: str) -> str:
    """A folded phrase that stands alone, for folded text. The literal comes first,
    so that the search skips to it; what is before it is looked back at."""
    body = escape_regex(phrase)
    return f"{body}(?<!{WORD_CHAR}{body})(?!{WORD_CHAR})"


def extract_skills(text: Column, skills: Sequence[str], word: bool = True,
                   folded_text: Column | None = None) -> Column:
    """The skills found in ``text`` (each once, taxonomy order); null or
    blank text gives an empty array. The rows are those of ``phrase_pattern``.

    Texts and skills are compared in their folded form (``functions.text.fold``;
    ``folded_text`` where it is a column already). A whole phrase is a substring,
    so its expression runs only on texts that hold the skill at all.
    """
    at = fold(text) if folded_text is None else folded_text
    hits = [F.when(at.contains(f) & at.rlike(_whole(f)) if word else at.contains(f), F.lit(s)) for s, f in ((s, folded(s)) for s in skills)]
    return F.coalesce(F.array_compact(F.array(*hits)), F.array().cast("array<string>"))


def extract_forms(skills: Sequence[str], folded_text: Column) -> Column:
    """X2 and X5 at once: (skill, word) of the skills that stand in a folded text,
    and whether one does so as a whole phrase."""
    hits = [F.when(folded_text.contains(f), F.struct(F.lit(s).alias("skill"), folded_text.rlike(_whole(f)).alias("word")))
            for s, f in ((s, folded(s)) for s in skills)]
    return F.array_compact(F.array(*hits))


def apply_extraction(df: DataFrame, text_col: str,
                     taxonomy: Mapping[str, Sequence[str]] = DEFAULT_TAXONOMY,
                     word: bool = True, out: str = "skills_found") -> DataFrame:
    """Add the ``skills_found`` array column.

    The folded text is a column of its own first: referenced once per skill,
    it is computed once per row instead of once per skill.
    """
    skills = [s for _, s in flatten_taxonomy(taxonomy)]
    return (df.withColumn("_folded", fold(F.col(text_col)))
              .withColumn(out, extract_skills(F.col(text_col), skills, word, F.col("_folded")))
              .drop("_folded"))


def explode_skills(df: DataFrame, col: str = "skills_found", out: str = "skill") -> DataFrame:
    """One row per found skill; rows with no skill disappear.

    Written as ``explode_outer`` + a null filter: a plain ``explode`` lets the
    optimizer infer ``size(array) > 0`` and push that copy of the whole
    extraction below the repartition onto the scan, running it twice.
    """
    return (df.withColumn(out, F.explode_outer(F.col(col))).drop(col)
              .filter(F.col(out).isNotNull()))


def flatten_nested(col: Column) -> Column:
    """Flatten an accidentally nested list column."""
    return F.flatten(col)


def attach_category(df: DataFrame, taxonomy: DataFrame, skill: str = "skill") -> DataFrame:
    """Skill -> category through the taxonomy; 'Unknown' if absent."""
    return (df.join(taxonomy.select(F.col("skill").alias(skill), "category"), skill, "left")
              .withColumn("category", F.coalesce(F.col("category"), F.lit(UNKNOWN_CATEGORY))))
