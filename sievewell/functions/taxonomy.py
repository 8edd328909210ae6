"""Skills and domains a candidate's profile is read in: fixed values."""

from __future__ import annotations

# Skill, and how a posting may name it.
SKILLS: dict[str, tuple[str, ...]] = {
    "java": ("java",),
    "spring": ("spring", "spring framework"),
    "spring_boot": ("spring boot", "springboot"),
    "aws": ("aws", "amazon web services"),
    "gcp": ("gcp", "google cloud", "google cloud platform"),
    "azure": ("azure", "microsoft azure"),
    "python": ("python",),
    "go": ("go", "golang"),
    "typescript": ("typescript", "ts"),
    "javascript": ("javascript", "js"),
    "react": ("react", "react.js", "reactjs"),
    "node": ("node", "node.js", "nodejs"),
    "kotlin": ("kotlin",),
    "flutter": ("flutter",),
    "dart": ("dart",),
    "php": ("php",),
    "sql": ("sql", "postgresql", "mysql", "oracle", "database"),
    "mongodb": ("mongodb", "mongo db", "mongo"),
    "redis": ("redis",),
    "kafka": ("kafka", "apache kafka"),
    "docker": ("docker", "container", "containers", "containerized"),
    "kubernetes": ("kubernetes", "k8s"),
    "terraform": ("terraform",),
    "microservices": ("microservice", "microservices"),
    "rest_api": ("rest", "rest api", "restful", "api design"),
    "jpa": ("jpa", "hibernate"),
    "sap_hybris": ("hybris", "sap hybris", "sap commerce", "sap commerce cloud"),
    "stripe": ("stripe",),
    "shopify": ("shopify",),
}
# Domain, and the words that tell it.
DOMAINS: dict[str, tuple[str, ...]] = {
    "ecommerce_platforms": ("ecommerce", "e-commerce", "commerce", "checkout", "cart", "retail"),
    "commerce_performance": ("performance", "scalability", "reliability", "high availability", "load"),
    "payment_integrations": ("payment", "payments", "stripe"),
    "omnichannel_retail": ("omnichannel", "inventory", "order management", "oms", "retail"),
    "mobile_cross_platform": ("flutter", "dart", "mobile"),
    "enterprise_java": ("java", "spring", "jpa", "hibernate"),
    "distributed_teams": ("international", "global team", "multicultural", "distributed"),
    "distributed_product_systems": ("distributed systems", "distributed system", "webhooks", "apis", "async integrations"),
    "event_driven_architecture": ("event-driven", "event driven", "kafka", "messaging", "pub/sub"),
    "system_design": ("system design", "architecture", "scalability", "reliability"),
    "frontend_fullstack": ("react", "typescript", "frontend", "full stack", "full-stack"),
    "cloud_basics": ("aws", "gcp", "azure", "cloud"),
    "data_pipelines": ("data pipeline", "streaming", "cdc", "kafka streams", "etl"),
    "infrastructure_as_code": ("terraform", "cdk", "cloudformation", "infrastructure as code", "iac"),
    "kubernetes": ("kubernetes", "k8s"),
}
# Domains that tell the shape of work, not a specialisation.
GENERIC_DOMAINS = ("enterprise_java", "distributed_teams", "distributed_product_systems", "event_driven_architecture", "system_design", "frontend_fullstack", "cloud_basics", "commerce_performance")
# Themes that a profile's prose and a posting may share.
AFFINITY_THEMES = {
    "gaming": ("game", "games", "gaming", "entertainment", "player", "unity", "unreal"),
    "commerce": ("retail", "commerce", "ecommerce", "e-commerce", "checkout", "payment", "fashion"),
    "mobile": ("mobile", "ios", "android", "smartphone", "app"),
    "platform": ("platform", "performance", "reliability", "scalability"),
}
# Words of concrete working conditions.
STRUCTURED_CONDITIONS = ("salary", "bonus", "holiday", "holidays", "paid leave", "annual leave", "insurance", "allowance", "commuting expenses", "remote work allowance", "flex-time", "flextime", "social insurance", "pension", "福利厚生", "休日休暇", "勤務時間", "勤務地", "勤務形態", "給与")
# How skills and domains are written where their id with spaces is not it.
SKILL_LABELS = {"spring_boot": "Spring Boot", "spring": "Spring", "rest_api": "REST APIs", "sap_hybris": "SAP Commerce / Hybris", "sql": "SQL / PostgreSQL"}
READING_SKILL_LABELS = SKILL_LABELS | {"aws": "AWS", "gcp": "GCP", "react": "React", "typescript": "TypeScript", "mongodb": "MongoDB"}
DOMAIN_LABELS = {"ecommerce_platforms": "e-commerce / commerce platforms"}
READING_DOMAIN_LABELS = DOMAIN_LABELS | {"frontend_fullstack": "frontend delivery", "cloud_basics": "cloud environments", "event_driven_architecture": "event-driven patterns"}


def skill_ids(named: tuple[str, ...]) -> tuple[str, ...]:
    """The skills whose alias any of the named skills holds, in the order above."""
    return tuple(k for k, aliases in SKILLS.items() if any(a in n.strip().lower() for n in named for a in aliases))


def skill_label(skill: str, labels: dict[str, str] = SKILL_LABELS) -> str:
    words = skill.replace("_", " ")
    return labels.get(skill) or words[0].upper() + words[1:]


def domain_label(domain: str, labels: dict[str, str] = DOMAIN_LABELS) -> str:
    return labels.get(domain) or domain.replace("_", " ")
