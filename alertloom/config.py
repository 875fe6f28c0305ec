"""Run settings and keyword rules.

Rules are small, user-written lists.  They live on the driver and enter plans as
literals, so nothing that grows with the data is ever broadcast because of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: default keyword lists, in configured order -----------------
LOCATIONS = (
    "casablanca", "casa", "morocco", "maroc", "remote morocco", "remote maroc",
    "hybride casablanca", "hybrid casablanca",
)
INTERNSHIP_TERMS = (
    "stage", "stage pfe", "pfe", "stage de fin d'études", "stage fin d'études",
    "fin d'études", "pré-embauche", "pre-embauche", "pré embauche", "pre embauche",
    "stage 6 mois", "stage de 6 mois", "stage 4 mois", "stage 3 mois",
    "stage ingénieur", "stage académique", "stagiaire", "internship", "intern",
)
EXCLUDED_TITLE_TERMS = (
    "senior", "manager", "directeur", "directrice", "architecte", "commercial",
    "marketing", "comptable", "juriste",
)
SKILLS = (
    "informatique", "développement", "développement web", "développement logiciel",
    "software", "web", "mobile", "data", "big data", "data analyst", "data science",
    "machine learning", "intelligence artificielle", "cybersécurité",
    "sécurité informatique", "réseaux", "cloud", "ERP", "CRM",
    "Java", "JavaScript", "TypeScript", "Python", "C#", "C++", "PHP",
    "Spring", "Spring Boot", "Node.js", "Express", "NestJS", ".NET", "Django", "Laravel",
    "Angular", "React", "Next.js", "Vue.js",
    "Docker", "Kubernetes", "Jenkins", "GitLab CI", "GitHub Actions", "CI/CD", "DevOps",
    "AWS", "Azure", "Google Cloud",
    "PostgreSQL", "MySQL", "MongoDB", "Oracle", "SQL",
    "Full Stack", "Backend", "Frontend", "Software Engineer", "Software Developer",
    "Génie logiciel", "Génie informatique", "Développeur", "Developer", "IT",
)
# Terms that are ordinary words in lower case match only as they are written.
EXACT_CASE_TERMS = ("it",)
# Title boosts: the first group with a word contained in the title counts.
TITLE_BOOSTS = (
    (("pfe", "stage", "internship", "stagiaire", "intern"), 8),
    (("software", "developpeur", "développeur", "developer", "full stack", "full-stack",
      "backend", "frontend", "data", "devops", "cloud"), 7),
)
LOCATION_REASON = "Casablanca/Morocco location"
QUERIES = (
    "stage informatique", "stage pfe informatique", "stage fin d'études informatique",
    "stage pré embauche", "stage 6 mois informatique", "stage développeur",
    "stage ingénieur informatique", "stagiaire informatique", "stage java", "stage react",
    "stage full stack", "stage devops", "stage data", "stage web", "stage cybersécurité",
    "software engineer internship",
)
# name, enabled, kind, search_url, url, default_location, company, queries
SOURCES = (
    ("dreamjob", True, "wordpress", "https://www.dreamjob.ma/?s={query}", None, "Morocco", None, None),
    ("rekrute", True, "rekrute",
     "https://www.rekrute.com/offres.html?st=d&keywordNew=1&jobLocation=RK&keyword={query}",
     None, "Morocco", None, None),
    ("talent", True, "talent", "https://ma.talent.com/jobs?k={query}&l=Casablanca",
     None, "Casablanca, Morocco", None, None),
    ("deloitte", True, "successfactors",
     "https://apply.deloitte.com/en_US/careers/SearchJobs/?listFilterMode=1&jobRecordsPerPage=20&keyword={query}",
     None, "Global", "Deloitte", ["stage maroc", "intern morocco"]),
    ("emploi_ma", True, "generic",
     "https://www.emploi.ma/recherche-jobs-maroc?f%5B0%5D=im_field_offre_region%3A76&keys={query}",
     None, "Morocco", None,
     ["stage informatique", "stage pfe", "stage développeur", "stagiaire informatique"]),
    ("emploi_ma_rss", True, "rss", None, "https://www.emploi.ma/rss.xml", "Morocco", None, None),
)
# --- end of fixed values ------------------------------------------------------

SOURCES_SCHEMA = (
    "source_pos long, name string, enabled boolean, kind string, search_url string, "
    "url string, default_location string, company string, queries array<string>"
)


@dataclass(frozen=True)
class Rules:
    """The keyword policy: four ordered term lists plus title boosts."""

    locations: tuple[str, ...] = LOCATIONS
    terms: tuple[str, ...] = INTERNSHIP_TERMS
    skills: tuple[str, ...] = SKILLS
    excluded: tuple[str, ...] = EXCLUDED_TITLE_TERMS
    exact_case: tuple[str, ...] = EXACT_CASE_TERMS
    title_boosts: tuple[tuple[tuple[str, ...], int], ...] = TITLE_BOOSTS
    location_reason: str = LOCATION_REASON


@dataclass(frozen=True)
class Settings:
    """Limits of one run."""

    max_age_days: int = 7
    priority_hours: int = 24
    max_results: int = 40
    date_check_max: int | None = None
    retention_days: int = 90
    max_lanes: int = 8
    delay_seconds: float = 0.6
    queries: tuple[str, ...] = field(default=QUERIES)


def default_sources(spark):
    """The configured sources as a DataFrame, in order."""
    rows = [(i, *row) for i, row in enumerate(SOURCES)]
    return spark.createDataFrame(rows, SOURCES_SCHEMA)
