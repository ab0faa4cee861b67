"""Fixed values of the features: cue lists, ladders, lookup tables, saturations."""

# Title ladder, rank and cues; and what a title without a cue has.
TITLE_LADDER = (
    (0.0, ("intern", "trainee", "apprentice")),
    (1.0, ("junior", "jr ", "jr.", "associate", "entry", "graduate")),
    (2.0, ("engineer", "developer", "analyst", "scientist", "programmer", "sde")),
    (3.0, ("senior", "sr ", "sr.", "lead", "specialist", "ii", "iii")),
    (4.0, ("staff", "principal", "architect", "manager", "head", "director")),
    (5.0, ("vp", "vice president", "chief", "cto", "ceo", "founder", "co-founder", "partner")),
)
TITLE_DEFAULT = 2.0
# Scope ladder over descriptions.
SCOPE_LADDER = (
    (5.0, ("founded", "co-founded", "started the company", "p&l", "org of")),
    (4.0, ("managed a team", "led a team", "led the team", "people management", "direct reports", "headcount", "hired", "owned the", "set the strategy", "roadmap ownership", "architected", "org-wide")),
    (3.0, ("led", "owned", "drove", "mentored", "designed", "spearheaded", "end-to-end", "cross-functional")),
    (2.0, ("built", "implemented", "developed", "shipped", "wrote", "coded", "delivered", "contributed")),
)
SCOPE_DEFAULT = 1.0
# Cues of roles.
CONSULTING_FIRMS = ("tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini", "deloitte", "hcl", "tech mahindra", "mindtree", "mphasis", "ibm global services", "ltimindtree", "persistent systems")
CONSULTING_CUES = ("consulting", "consultancy", "client", "clients", "staff augmentation", "outsourc", "managed services", "system integrat", "body shop", "billable", "engagement", "sow", "client-facing")
PRODUCT_CUES = ("product", "saas", "platform", "our app", "our users", "feature flag", "a/b test", "growth", "consumer", "in-house", "proprietary product", "product-led", "user base", "mau", "dau")
CODING_CUES = (
    "python", "java", "c++", "golang", "rust", "scala", "typescript", "pytorch", "tensorflow", "spark", "kubernetes", "sql",
    "wrote", "coded", "implemented", "built", "developed", "refactored", "debugged", "unit test", "pull request", "code review", "commit",
)
ARCHITECTURE_CUES = ("oversaw", "strategy", "roadmap", "stakeholder", "governance", "steering", "high-level design", "review boards", "vendor management", "budget", "presentation")
RESEARCH_CUES = ("research", "published", "publication", "paper", "novel approach", "phd", "thesis", "state-of-the-art", "neurips", "icml", "acl", "cvpr", "prototype only", "proof of concept", "experimental study")
MANAGEMENT_CUES = ("managed a team", "people management", "direct reports", "headcount", "hiring", "performance reviews", "1:1s", "team of", "line manager", "managed engineers", "delegated")
PRODUCTION_CUES = ("production", "in prod", "deployed", "serving", "live traffic", "at scale", "latency", "throughput", "uptime", "sla", "ci/cd", "monitoring", "on-call", "rollout", "millions of", "qps", "p99")
TECH_NAMES = ("python", "java", "c++", "golang", "rust", "scala", "typescript", "pytorch", "tensorflow", "spark", "kubernetes", "sql", "kafka", "airflow", "ray", "onnx")
OPEN_SOURCE_CUES = ("open source", "open-source", "github", "oss", "contributor", "maintainer", "published", "patent", "paper")
FOUNDER_TITLES = ("founder", "co-founder", "cofounder")
SENIORITY_CUES = ("principal", "staff", "director", "vp", "vice president", "head", "chief", "cto", "architect", "distinguished")
# Industries and firms of the career slice, which are not those of the cues above.
PRODUCT_INDUSTRIES = (
    "software", "product", "saas", "internet", "technology", "fintech", "e-commerce", "edtech", "ai/ml", "adtech", "healthtech",
    "healthtech ai", "conversational ai", "voice ai", "ai services", "insurance tech", "gaming", "consumer electronics", "media", "food delivery", "transportation",
)
SLICE_FIRMS = ("tcs", "tata consultancy", "infosys", "wipro", "accenture", "cognizant", "capgemini", "hcl", "mindtree", "tech mahindra", "mphasis")
# Tokens of the nine competency concepts.
CONCEPTS = {
    "retr": ("retrieval", "indexing", "elasticsearch", "solr"),
    "rank": ("ranking", "ranker", "relevance", "reranking"),
    "recsys": ("recommendation", "recommender", "recsys", "personalization"),
    "ir": ("embeddings", "ann", "faiss", "retrieval"),
    "nlp": ("nlp", "tokenization", "transformer"),
    "llm": ("llm", "gpt", "langchain", "openai", "prompt"),
    "mle": ("pytorch", "tensorflow", "scikit"),
    "mlops": ("mlops", "mlflow", "kubeflow"),
    "eval": ("benchmarking", "ndcg", "mrr"),
}
# Words without weight, and markers of sentences that disclaim.
STOPWORDS = ("and", "the", "for", "with", "of", "to", "in", "on", "a", "an", "at", "by")
HEDGES = (
    "interested in transitioning",
    "professional experience there is limited",
    "limited professional experience",
    "haven't done it in a professional capacity",
    "have not done it in a professional capacity",
    "still building depth",
    "beyond the surface level",
    "self-learner level",
)
# Places, institutions, fields of study.
HUBS = ("pune", "noida", "hyderabad", "mumbai", "delhi", "new delhi", "delhi ncr", "ncr", "gurgaon", "gurugram", "ghaziabad", "faridabad", "greater noida")
TIER_SCORES = {"tier_1": 1.0, "tier_2": 0.75, "tier_3": 0.5, "tier_4": 0.25, "unknown": 0.4}
FIELD_RELEVANCE = (
    (1.0, ("machine learning", "artificial intelligence", "information retrieval", "natural language processing")),
    (0.9, ("computer science", "data science")),
    (0.8, ("computational",)),
    (0.7, ("statistics",)),
    (0.65, ("applied mathematics",)),
    (0.6, ("mathematics", "information systems", "software engineering")),
    (0.5, ("electrical engineering",)),
    (0.45, ("electronics", "physics")),
    (0.4, ("engineering",)),
)
