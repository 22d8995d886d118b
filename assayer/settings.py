"""Every constant of the engine in one place; all operators take it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the reference's for equal results.
SCORE_BANDS = (("0-20", 0, 20), ("21-40", 21, 40), ("41-60", 41, 60), ("61-80", 61, 80), ("81-100", 81, 100))
LEARNING_BANDS = ((0.78, "5-7 days", "strong"), (0.62, "10-14 days", "moderate"), (0.0, "21-28 days", "weak"))
PARTIAL_LEARNING_TIME = "2-4 days"
FALLBACK_CATEGORY = "General Technical Skill"
WORKFLOW_STATUSES = ("Applied", "Screening", "Technical", "Manager", "HR", "Offer", "Joined", "Rejected")
TAXONOMY = {
    "Languages": ["python", "javascript", "typescript", "java", "c++", "c#", "go", "golang", "rust", "ruby", "php", "swift", "kotlin", "scala"],
    "Frontend": ["react", "angular", "vue", "next.js", "nextjs", "nuxt", "svelte", "tailwind", "css", "html", "bootstrap", "sass", "webpack", "vite"],
    "Backend": ["fastapi", "django", "flask", "express", "node.js", "nodejs", "spring boot", "laravel", "rails", "asp.net", "nest.js", "nestjs"],
    "Databases": ["postgresql", "postgres", "mysql", "sqlite", "mongodb", "redis", "cassandra", "dynamodb", "elasticsearch", "neo4j", "mariadb"],
    "Cloud & DevOps": ["aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "k8s", "terraform", "ansible", "jenkins", "git", "github", "gitlab", "ci/cd"],
    "AI & Data Science": ["tensorflow", "pytorch", "keras", "scikit-learn", "numpy", "pandas", "scipy", "llm", "llama", "rag", "langchain", "llamaindex", "huggingface", "bert", "openai", "claude", "nlp", "computer vision", "opencv"],
    "Methodologies & Practices": ["agile", "scrum", "tdd", "unit testing", "rest api", "graphql", "microservices", "system design"],
}


def taxonomy_terms() -> list[str]:
    """All terms, longest first, then by name."""
    return sorted({t for terms in TAXONOMY.values() for t in terms}, key=lambda t: (-len(t), t))


@dataclass(frozen=True)
class Settings:
    weight_coverage: float = 0.35
    weight_experience: float = 0.25
    weight_projects: float = 0.20
    weight_confidence: float = 0.15
    weight_quality: float = 0.05
    rank_similarity: float = 0.70
    rank_section: float = 0.15
    rank_density: float = 0.05
    rank_technical: float = 0.10
    chunk_target: int = 350
    chunk_max: int = 600
    chunk_overlap: int = 1
    fuse_dense: float = 0.6
    fuse_sparse: float = 0.4
    fuse_k: int = 60
    similarity_floor: float = 0.62
    selected_min: int = 80
    borderline_min: int = 60
    daily_days: int = 30
    weekly_weeks: int = 12
    monthly_months: int = 12
    top_limit: int = 5
    recent_limit: int = 10
    category_floor: float = 0.50
    same_category_boost: float = 0.10
    equivalent_min: float = 0.80
    related_min: float = 0.68
    stuffing_medium: float = 0.25
    stuffing_high: float = 0.50
    quality_corroboration: float = 0.60
    quality_depth: float = 0.40
    weight_must: float = 1.0
    weight_nice: float = 0.4
    matched_min: int = 75
    bm25_k1: float = 1.5
    bm25_b: float = 0.75


DEFAULTS = Settings()
