"""A seeded pool of nested records: diverse ones, impossible ones, consulting-only ones."""

from __future__ import annotations

import json
import random
from pathlib import Path

AS_OF = "2024-06-18"
SKILLS = ("Python", "Retrieval", "Ranking", "NLP", "LLM", "PyTorch", "MLOps", "Embeddings", "FAISS", "SQL", "Recommendation", "NDCG")
TEXTS = (
    "Built and deployed a retrieval and ranking platform in production, serving millions of users with low latency.",
    "Implemented embeddings and faiss search, measured ndcg and mrr in offline eval and a/b test.",
    "Developed nlp and llm features in python and pytorch, shipped to our users.",
    "Led a team that owned the recommendation service; monitoring, on-call and rollout.",
)
CITIES = ("Pune, Maharashtra", "Noida, UP", "Bengaluru, Karnataka", "Chennai, Tamil Nadu")


def _role(rng: random.Random, start: int, months: int, current: bool, **over) -> dict:
    r = {"company": rng.choice(("Acme", "Globex", "Initech", "Umbrella")), "title": rng.choice(("ML Engineer", "Senior Engineer", "Data Scientist")), "start_date": f"{start}-01-01", "end_date": None if current else f"{start + months // 12}-{months % 12 + 1:02d}-01",
         "duration_months": months, "is_current": current, "industry": rng.choice(("Software", "Fintech", "SaaS")), "company_size": rng.choice(("11-50", "51-200", "1001-5000")), "description": rng.choice(TEXTS)}
    return r | over


def record(rng: random.Random, cid: str, **over) -> dict:
    years = rng.randint(2, 12)
    skills = [{"name": n, "proficiency": rng.choice(("beginner", "intermediate", "advanced", "expert")), "endorsements": rng.randint(0, 60), "duration_months": rng.choice((None, *range(1, 61)))} for n in rng.sample(SKILLS, rng.randint(2, 6))]
    n = min(rng.randint(1, 3), max(years // 2, 1))
    span = max(years // n, 1)
    roles = []
    for k in range(n):
        start = 2024 - span * (k + 1)
        roles.append(_role(rng, start, (span * 12 + (5 if k == 0 else 0)), k == 0))
    r = {
        "candidate_id": cid,
        "profile": {"anonymized_name": f"Person {cid[-4:]}", "headline": "Engineer", "summary": rng.choice(TEXTS), "location": rng.choice(CITIES), "country": "India", "years_of_experience": float(years), "current_title": roles[0]["title"], "current_company": roles[0]["company"], "current_company_size": roles[0]["company_size"], "current_industry": roles[0]["industry"]},
        "career_history": roles,
        "education": [{"institution": "Institute", "degree": "B.Tech", "field_of_study": "Computer Science", "start_year": 2024 - years - 5, "end_year": 2024 - years - 1, "grade": None, "tier": rng.choice(("tier_1", "tier_2", "tier_3"))}],
        "skills": skills,
        "certifications": [],
        "languages": [{"language": "English", "proficiency": "professional"}],
        "signals": {
            "profile_completeness_score": rng.uniform(40, 100), "signup_date": "2022-01-01", "last_active_date": f"2024-0{rng.randint(1, 6)}-10", "open_to_work_flag": rng.random() < 0.6, "profile_views_received_30d": rng.randint(1, 200), "applications_submitted_30d": rng.randint(0, 30),
            "recruiter_response_rate": rng.random(), "avg_response_time_hours": rng.uniform(1, 72), "skill_assessment_scores": {s["name"]: rng.uniform(30, 100) for s in skills if rng.random() < 0.5}, "connection_count": rng.randint(10, 1500), "endorsements_received": rng.randint(0, 100),
            "notice_period_days": rng.choice((0, 15, 30, 45, 60, 90, 120)), "expected_salary_range_inr_lpa": {"min": 20.0, "max": rng.choice((18.0, 35.0, 50.0))}, "preferred_work_mode": rng.choice(("remote", "hybrid", "onsite", "flexible")), "willing_to_relocate": rng.random() < 0.5,
            "github_activity_score": rng.choice((-1.0, 10.0, 55.0, 90.0)), "search_appearance_30d": rng.randint(0, 100), "saved_by_recruiters_30d": rng.randint(0, 20), "interview_completion_rate": rng.random(), "offer_acceptance_rate": rng.choice((-1.0, 0.5, 0.9)),
            "verified_email": True, "verified_phone": rng.random() < 0.5, "linkedin_connected": True,
        },
    }
    return r | over


def pool(n: int = 130, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    rows = [record(rng, f"CAND_{k:07d}") for k in range(1, n + 1)]
    for k in range(3):
        r = record(rng, f"CAND_900000{k + 1}")
        r["profile"]["years_of_experience"] = 2.0
        r["career_history"] = [_role(rng, 2014, 120, True)]
        r["skills"] = [{"name": s, "proficiency": "expert", "endorsements": 0, "duration_months": rng.choice((None, 0))} for s in SKILLS[:5]]
        r["signals"]["skill_assessment_scores"] = {}
        rows.append(r)
    for k in range(2):
        r = record(rng, f"CAND_900000{k + 4}")
        r["career_history"] = [_role(rng, 2020, 53, True, company="TCS", industry="IT Services"), _role(rng, 2017, 36, False, company="Infosys", industry="IT Services")]
        rows.append(r)
    return rows


def write(path: Path, rows: list[dict], extra: tuple[str, ...] = ()) -> str:
    path.write_text("\n".join([*(json.dumps(r) for r in rows), *extra]) + "\n")
    return str(path)
