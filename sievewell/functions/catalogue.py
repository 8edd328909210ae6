"""The catalogue of signals: group and extra penalty of each, in order of detection."""

from __future__ import annotations

# Fixed values: (signal, priority group).
POSITIVE = (
    ("salary_transparency", "salary"),
    ("hybrid_work", "hybrid_work"),
    ("remote_friendly", "hybrid_work"),
    ("english_environment", "english_environment"),
    ("product_company", "product_company"),
    ("engineering_culture", "engineering_culture"),
    ("engineering_environment", "engineering_culture"),
    ("inhouse_product_engineering", "product_company"),
    ("global_team_collaboration", "english_environment"),
    ("english_support_environment", "english_environment"),
    ("visa_sponsorship_support", "english_environment"),
    ("work_life_balance", "work_life_balance"),
    ("stability", "stability"),
    ("product_pm_collaboration", "product_company"),
    ("engineering_maturity", "engineering_culture"),
    ("casual_interview", "engineering_culture"),
    ("async_communication", "work_life_balance"),
    ("real_flextime", "work_life_balance"),
    ("low_overtime_disclosed", "work_life_balance"),
    ("candidate_stack_fit", "engineering_culture"),
    ("candidate_domain_fit", "product_company"),
    ("candidate_seniority_fit", "engineering_culture"),
    ("company_reputation_positive", "stability"),
    ("company_reputation_positive_strong", "stability"),
)
# Fixed values: (signal, priority group, extra penalty).
RISK = (
    ("salary_low_confidence", "salary", 0),
    ("salary_below_persona_floor", "salary", 0),
    ("onsite_bias", "hybrid_work", 2),
    ("japanese_assignment_dependency", "english_environment", 0),
    ("language_friction", "english_environment", 0),
    ("language_friction_critical", "english_environment", 4),
    ("overtime_risk", "work_life_balance", 2),
    ("engineering_environment_risk", "work_life_balance", 0),
    ("role_mismatch_manager_vs_ic_title", "engineering_culture", 2),
    ("role_identity_mismatch", "engineering_culture", 3),
    ("intermediary_contract_risk", "product_company", 2),
    ("anonymous_employer_risk", "product_company", 0),
    ("generic_marketing_post_risk", "product_company", 0),
    ("vague_conditions_risk", "work_life_balance", 0),
    ("inclusion_contradiction", "english_environment", 2),
    ("pre_ipo_risk", "stability", 1),
    ("manager_scope_salary_misaligned", "salary", 2),
    ("workload_policy_risk", "work_life_balance", 3),
    ("holiday_policy_risk", "work_life_balance", 2),
    ("location_mobility_risk", "hybrid_work", 1),
    ("salary_range_anomaly", "salary", 3),
    ("debt_first_culture_risk", "engineering_culture", 3),
    ("hypergrowth_execution_risk", "stability", 2),
    ("startup_risk", "stability", 0),
    ("consulting_risk", "product_company", 0),
    ("algorithmic_interview_risk", "engineering_culture", 0),
    ("pressure_culture_risk", "work_life_balance", 0),
    ("fake_flextime_risk", "work_life_balance", 0),
    ("traditional_corporate_process_risk", "english_environment", 0),
    ("customer_site_risk", "product_company", 0),
    ("candidate_stack_gap", "engineering_culture", 2),
    ("candidate_domain_gap", "product_company", 0),
    ("candidate_seniority_mismatch", "engineering_culture", 2),
    ("company_reputation_risk", "stability", 0),
    ("company_reputation_risk_high", "stability", 0),
)
