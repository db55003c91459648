"""A controlled vocabulary of skills: recognition, canonical names, support, overlap.

All of it is Column expressions. Text is searched once, by one pattern for the whole vocabulary:
a look-ahead at each word start captures the longest alias there, and a literal map
names every skill that this alias implies (an alias may begin with another: "github actions", "github").
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical skill -> aliases. Results depend on this exact vocabulary.
SKILLS: dict[str, tuple[str, ...]] = {
    "Python": ("python",),
    "Java": ("java",),
    "JavaScript": ("javascript", "js", "es6"),
    "TypeScript": ("typescript", "ts"),
    "C++": ("c++", "cpp"),
    "C#": ("c#", "csharp", ".net"),
    "Go": ("golang", "go语言"),
    "R": ("r语言", "r programming"),
    "SQL": ("sql", "sql queries"),
    "Bash": ("bash", "shell scripting", "shell script"),
    "Git": ("git", "github", "gitlab", "version control"),
    "Linux": ("linux", "unix"),
    "Docker": ("docker", "containerisation", "containerization"),
    "Kubernetes": ("kubernetes", "k8s"),
    "CI/CD": ("ci/cd", "continuous integration", "cicd", "jenkins", "github actions"),
    "REST APIs": ("rest api", "restful", "rest apis"),
    "Microservices": ("microservice", "microservices"),
    "Unit Testing": ("unit test", "unit tests", "unit testing", "pytest", "junit"),
    "Agile": ("agile", "scrum", "kanban"),
    "Pandas": ("pandas",),
    "NumPy": ("numpy",),
    "Data Cleaning": ("data cleaning", "data wrangling", "data preprocessing"),
    "Data Visualisation": ("data visualisation", "data visualization", "tableau", "power bi", "powerbi", "matplotlib", "seaborn"),
    "Statistics": ("statistics", "statistical analysis", "hypothesis testing"),
    "A/B Testing": ("a/b test", "a/b testing", "ab testing", "experimentation"),
    "Excel": ("excel", "spreadsheet"),
    "ETL": ("etl", "elt", "data pipeline", "airflow", "dbt"),
    "BigQuery": ("bigquery",),
    "Snowflake": ("snowflake",),
    "Dashboarding": ("dashboard", "dashboarding", "dashboards", "reporting suite"),
    "Machine Learning": ("machine learning", "ml models", "supervised learning"),
    "Deep Learning": ("deep learning", "neural network", "neural networks"),
    "PyTorch": ("pytorch", "torch"),
    "TensorFlow": ("tensorflow", "keras"),
    "scikit-learn": ("scikit-learn", "scikit learn", "sklearn"),
    "NLP": ("nlp", "natural language processing", "text classification"),
    "Computer Vision": ("computer vision", "cv models", "image classification"),
    "LLM": ("llm", "llms", "large language model", "large language models"),
    "RAG": ("rag", "retrieval augmented generation", "retrieval-augmented generation"),
    "Prompt Engineering": ("prompt engineering", "prompt design"),
    "Vector Database": ("vector database", "vector db", "chroma", "faiss", "pinecone"),
    "MLOps": ("mlops", "model deployment", "model serving"),
    "Feature Engineering": ("feature engineering", "feature extraction"),
    "Model Evaluation": ("model evaluation", "cross-validation", "cross validation"),
    "Hugging Face": ("hugging face", "huggingface", "transformers library"),
    "Product Roadmap": ("roadmap", "product roadmap", "product strategy"),
    "User Research": ("user research", "user interviews", "usability testing"),
    "Wireframing": ("wireframe", "wireframing", "prototype", "figma"),
    "Backlog Grooming": ("backlog", "user stories", "sprint planning"),
    "Stakeholder Management": ("stakeholder", "stakeholders", "cross-functional"),
    "Market Analysis": ("market analysis", "competitive analysis", "market research"),
    "Product Metrics": ("product metrics", "kpi", "kpis", "north star metric"),
    "Jira": ("jira", "confluence"),
}
# Phrases that are no skills.
SOFT_FILLERS = (
    "team player", "communication", "communications", "self-starter", "attention to detail", "fast-paced",
    "fast paced", "proactive", "passionate", "motivated", "hard working", "detail-oriented", "detail oriented",
    "interpersonal skills", "problem solving", "problem-solving",
)
#: Aliases of at least so many characters are looked for in text; shorter ones name a skill only when given alone.
MIN_ALIAS = 3


def alias_rows() -> list[tuple[str, str]]:
    """Pairs of alias and canonical name."""
    return [(a, c) for c, aliases in SKILLS.items() for a in aliases]


def normalise_key(text: str) -> str:
    return " ".join(re.sub(r"[^a-z0-9+#]+", " ", text.lower()).split())


def trie(words: Iterable[str]) -> str:
    """A pattern for any of the words, longest first, with common starts factored out."""
    groups: dict[str, list[str]] = {}
    ends = False
    for w in words:
        if w:
            groups.setdefault(w[0], []).append(w[1:])
        else:
            ends = True
    if not groups:
        return ""
    alternatives = [re.escape(c) + trie(rest) for c, rest in sorted(groups.items())]
    body = "(?:" + "|".join(alternatives) + ")"
    return body + ("?" if ends else "")


def _implied() -> dict[str, list[str]]:
    """Alias found -> every skill that its text names from the same start."""
    rows = [(a, c) for a, c in alias_rows() if len(a) >= MIN_ALIAS]
    out = {}
    for a, _ in rows:
        out[a] = sorted({c for b, c in rows if a == b or (a.startswith(b) and not re.match(r"[A-Za-z0-9]", a[len(b)]))})
    return out


IMPLIED = _implied()
PATTERN = r"(?i)(?<![A-Za-z0-9])(?=(" + trie(IMPLIED) + r")(?![A-Za-z0-9]))"
C_SHARP = r"(?i)(?<![A-Za-z0-9+#./\-])c#(?![A-Za-z0-9+#./\-])"


def _map(pairs: dict[str, str | list[str]]) -> Column:
    cells = []
    for k, v in pairs.items():
        cells += [F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)]
    return F.create_map(*cells)


def match_skills(text: Column) -> Column:
    """Sorted canonical skills literally present in a text; none for null or empty."""
    t = F.coalesce(text, F.lit(""))
    found = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(1)), F.lower))
    named = F.flatten(F.transform(found, lambda a: F.coalesce(F.element_at(_map(IMPLIED), a), F.array().cast("array<string>"))))
    sharp = F.when(t.rlike(C_SHARP), F.array(F.lit("C#"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(named, sharp)))


def normalise_skill(text: Column) -> Column:
    """Lower case, every run of other than letters, digits, + and # made one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9+#]+", " "))


def _exact() -> dict[str, str]:
    rows = {a.lower(): c for a, c in alias_rows()}
    for a, c in alias_rows():
        rows.setdefault(normalise_key(a), c)
    return rows


def canonicalise(value: Column) -> Column:
    """Canonical name: an alias, else the one skill that the string names, else the string trimmed."""
    exact = F.element_at(_map(_exact()), normalise_skill(value))
    t = F.coalesce(value, F.lit(""))
    found = F.array_distinct(
        F.flatten(
            F.transform(
                F.regexp_extract_all(t, F.lit(PATTERN), F.lit(1)),
                lambda a: F.coalesce(F.element_at(_map(IMPLIED), F.lower(a)), F.array().cast("array<string>")),
            )
        )
    )
    return F.coalesce(exact, F.when(F.size(found) == 1, F.element_at(found, 1)), F.trim(value))


def word_in(needle: Column, hay: Column) -> Column:
    """Whether ``needle`` stands in ``hay`` with no letter or digit on either side; not for an empty needle."""
    pattern = F.concat(F.lit(r"(?<![a-z0-9])\Q"), needle, F.lit(r"\E(?![a-z0-9])"))
    return F.coalesce((F.length(needle) > 0) & F.regexp_like(hay, pattern), F.lit(False))


def has_lexical_support(claim: Column, source: Column, present: Column) -> Column:
    """Whether a source text evidences a claimed skill: its canonical name is ``present``, or its words stand in the text."""
    blank = F.coalesce(F.length(F.trim(claim)) == 0, F.lit(True))
    return ~blank & (
        F.coalesce(F.array_contains(present, canonicalise(claim)), F.lit(False))
        | word_in(normalise_skill(claim), normalise_skill(source))
    )


def skill_overlap(candidate: Column, required: Column) -> Column:
    """Share of the required skills that the candidate has; 0 if none is required."""
    return F.when(F.size(required) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(candidate, required)) / F.size(required)
    )


def ordered_skills(skills: Column, reference: Column | None = None) -> Column:
    """In the reference's order, then the rest by name."""
    by_name = F.array_sort(F.array_distinct(skills))
    if reference is None:
        return by_name
    first = F.filter(F.array_distinct(reference), lambda s: F.array_contains(skills, s))
    return F.concat(first, F.array_except(by_name, first))


def tidy_skills(values: Column) -> Column:
    """Trimmed skills without fillers and scraps; of equal ones the first spelling."""
    fillers = F.array(*[F.lit(x) for x in sorted({normalise_key(x) for x in SOFT_FILLERS})])
    kept = F.filter(
        F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)),
        lambda v: v.isNotNull() & (F.length(v) >= 2) & ~F.array_contains(fillers, normalise_skill(v)),
    )
    return first_spellings(kept)


def first_spellings(values: Column) -> Column:
    """One of each normalised key: its first spelling, in order."""
    keyed = F.transform(values, lambda v: F.struct(normalise_skill(v).alias("k"), v.alias("v")))
    one = lambda seen, x: F.when(F.array_contains(seen["keys"], x["k"]), seen).otherwise(
        F.struct(F.concat(seen["keys"], F.array(x["k"])).alias("keys"), F.concat(seen["kept"], F.array(x["v"])).alias("kept")))
    none = F.array().cast("array<string>")
    return F.aggregate(F.filter(keyed, lambda x: x["k"].isNotNull()), F.struct(none.alias("keys"), none.alias("kept")), one, lambda s: s["kept"])


def merged_skills(model: Column, literal: Column) -> Column:
    """Union of two ordered lists; the first list's spelling wins."""
    return first_spellings(F.concat(model, literal))


def skill_set(text: Column) -> Column:
    """Normalised canonical skills of a list in one string (split at ; , and |)."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;,|]"), lambda x: F.trim(x)), lambda p: F.length(p) > 0)
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: normalise_skill(canonicalise(p)))))


def rank_skills(candidate: Column, posting: Column, limit: int = 3) -> Column:
    """Shared skills by name, or the candidate's if none is shared; the first ``limit``."""
    shared = F.array_sort(F.array_intersect(candidate, posting))
    return F.slice(F.when(F.size(shared) > 0, shared).otherwise(F.array_sort(candidate)), 1, limit)
