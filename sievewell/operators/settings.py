"""Personas, tracked and blacklisted companies: small reference data, of the size of a config file."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.catalogue import POSITIVE, RISK


@dataclass(frozen=True)
class Company:
    name: str
    career_url: str = ""
    corporate_url: str = ""
    type_hint: str = ""
    notes: str = ""
    profile_tags: tuple[str, ...] = ()
    risk_tags: tuple[str, ...] = ()

    @property
    def site(self) -> str:
        return self.corporate_url or self.career_url

    @property
    def english_site(self) -> bool:
        url = self.site.strip().lower()
        return "/en/" in url or url.endswith("/en") or "locale=en" in url or "/global" in url

    @property
    def japanese_site(self) -> bool:
        url = self.site.strip().lower()
        return "/jp/" in url or url.endswith("/jp") or "locale=jp" in url or ".co.jp" in url

    @property
    def context(self) -> str:
        """What the company's own data adds to a posting's text."""
        words = [self.notes, self.type_hint, *self.profile_tags, *self.risk_tags]
        if self.site.strip():
            host = self.site.split("//", 1)[-1].split("/", 1)[0].lower()
            words.append(self.site)
            words += ["english site international team"] * self.english_site + ["japanese language site"] * self.japanese_site + ["japan company context"] * host.endswith(".co.jp")
        return " ".join(words) + " "


@dataclass(frozen=True)
class Persona:
    name: str
    priorities: tuple[str, ...] = ("english_environment", "product_company", "engineering_culture", "hybrid_work", "work_life_balance", "salary", "stability")
    hard_no: tuple[str, ...] = ("consulting_company", "early_stage_startup")
    weights: dict[str, int] = field(default_factory=dict)
    minimum_salary_yen: int = 0
    ranking: str = "by_score"

    def positive_weight(self, signal: str, group: str) -> int:
        return self.weights.get(signal, 2 if group in self.priorities else 1)

    def risk_weight(self, signal: str, group: str, extra: int) -> int:
        """A persona's own weight replaces the extra penalty too."""
        return self.weights.get(signal, (3 if group in self.priorities else 2) + extra)

    @property
    def score_range(self) -> tuple[int, int]:
        return -sum(self.risk_weight(*r) for r in RISK), sum(self.positive_weight(*p) for p in POSITIVE)


PERSONAS = (
    Persona("engineer"),
    Persona("engineer_strict", hard_no=("consulting_company", "early_stage_startup", "japanese_only_environment", "workload_overload", "forced_relocation")),
    Persona("engineer_pragmatic", hard_no=("early_stage_startup",), minimum_salary_yen=7_000_000),
)
#: Invented companies for the postings made from the driver's tables.
COMPANIES = (
    Company("Aomori Pay", "https://careers.aomoripay.example/", "https://aomoripay.example/en/", "fintech_product", "Marketplace product company.", ("expat_friendly", "engineering_brand", "reputation_strong")),
    Company("Kita Retail", "https://kita.example.co.jp/recruit/", "https://kita.example.co.jp/", "retail_product", "Large enterprise, mixed language environment.", ("stable_public", "product_leader"), ("language_friction_high",)),
    Company("Minato Learn", "https://jobs.minatolearn.example/", "", "edtech_startup", "Fast shipping.", (), ("overtime_risk", "layoff_risk")),
)
BLACKLIST = ("Umi Staffing", "Tama Placement")
