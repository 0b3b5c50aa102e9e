"""Constant dimensions: ontology profiles, keywords, intents, slot hints, phrases, baselines.

Every table here is fixed and small, so operators take it as literals or as a broadcast table.
Order is meaning: ties go to what stands first.
"""

from __future__ import annotations

# They must be these for right results.
PROFILES = {
    "governance": ("holds_role", "chairs", "serves_on_committee"),
    "financials": ("reports_metric", "reported_for_period", "segment_contribution"),
    "shareholder_return": ("announced_repurchase", "declared_dividend", "applies_to_share_class"),
}
ENTITY_TYPES = {
    "governance": ("LegalEntity", "Person", "OfficerRole", "Board", "Committee"),
    "financials": ("LegalEntity", "FinancialMetric", "ReportingPeriod", "BusinessSegment", "MonetaryAmount"),
    "shareholder_return": ("LegalEntity", "RepurchaseProgram", "Dividend", "ShareClass", "MonetaryAmount"),
}
SECTION_PROFILES = {"governance": "governance", "financials": "financials", "shareholder return": "shareholder_return"}
PROFILE_KEYWORDS = {
    "governance": ("board", "director", "audit committee", "chief executive officer", "governance", "chair", "officer"),
    "financials": ("revenue", "income", "cash", "debt", "liquidity", "margin", "operating", "quarter", "fiscal"),
    "shareholder_return": ("dividend", "repurchase", "buyback", "capital allocation", "shareholder return", "common stock", "authorization"),
}
ROLES = (
    "Chief Executive Officer",
    "Chief Financial Officer",
    "Chief Operating Officer",
    "Chief Human Resources Officer",
    "General Counsel",
    "Corporate Secretary",
    "director",
    "chair",
    "president",
)
COMMITTEES = ("audit committee", "compensation committee", "risk committee", "board")
METRICS = ("revenue", "net income", "operating income", "operating margin", "gross profit", "cash", "cash equivalents", "liquidity", "debt", "cash flow", "earnings")
SEGMENTS = ("consumer", "segment", "data and access solutions", "derivatives", "cash and spot markets")
TEMPLATE_RELATIONS = {
    "who-serves-on-committee": ("serves_on_committee",),
    "metric-for-period": ("reports_metric", "reported_for_period"),
    "shareholder-return-policy": ("announced_repurchase", "declared_dividend"),
    "governance-query": ("holds_role", "serves_on_committee"),
    "financials-query": ("reports_metric", "reported_for_period"),
    "shareholder-return-query": ("announced_repurchase", "declared_dividend"),
}
RELATION_PHRASES = {
    "holds_role": "holds the role",
    "serves_on_committee": "serves on",
    "chairs": "chairs",
    "reports_metric": "reports",
    "reported_for_period": "for period",
    "segment_contribution": "contributes through",
    "announced_repurchase": "announced repurchase activity tied to",
    "declared_dividend": "declared dividend tied to",
    "applies_to_share_class": "applies to share class",
}
#: Intents of each profile: id -> (trigger keywords, required relations, required entity types, focus slots).
INTENTS = {
    "governance": {
        "governance_role_transition": (("transition", "career", "progression", "tenure", "previously", "role"), ("holds_role",), ("Person", "OfficerRole"), ("person", "current_role", "prior_role")),
        "governance_committee_oversight": (
            ("committee", "audit", "oversight", "cybersecurity", "risk", "cio", "ciso"),
            ("serves_on_committee", "holds_role"),
            ("Committee", "Person"),
            ("committee", "oversight_roles", "oversight_topic"),
        ),
        "governance_board_structure": (("board", "director", "independent", "chair", "separation", "composition"), ("holds_role", "serves_on_committee"), ("Person", "Board"), ("board_leadership", "directors")),
        "governance_executive_roles": (("cfo", "coo", "general counsel", "legal", "executive", "officer", "ops"), ("holds_role",), ("Person", "OfficerRole"), ("executives", "roles")),
    },
    "financials": {
        "financials_liquidity_breakdown": (
            ("liquidity", "cash", "cash equivalents", "short-term", "short term", "coverage", "credit", "facility"),
            ("reports_metric", "reported_for_period"),
            ("FinancialMetric", "ReportingPeriod", "MonetaryAmount"),
            ("cash", "investments", "credit_facility", "period"),
        ),
        "financials_metric_delta": (
            ("delta", "change", "growth", "trend", "increase", "decrease", "from", "to"),
            ("reports_metric", "reported_for_period"),
            ("FinancialMetric", "ReportingPeriod", "MonetaryAmount"),
            ("metric", "current_period", "prior_period", "value_delta"),
        ),
        "financials_profitability_trend": (
            ("profitability", "margin", "gross profit", "operating income", "earnings", "eps", "net income"),
            ("reports_metric", "reported_for_period"),
            ("FinancialMetric", "ReportingPeriod", "MonetaryAmount"),
            ("metric", "periods", "values"),
        ),
        "financials_debt_profile": (
            ("debt", "notes", "interest", "repaid", "repay", "long-term debt", "lt debt"),
            ("reports_metric", "reported_for_period"),
            ("FinancialMetric", "ReportingPeriod", "MonetaryAmount"),
            ("debt_instrument", "period", "amount"),
        ),
    },
    "shareholder_return": {
        "shareholder_return_authorization": (
            ("authorization", "authorized", "remaining", "balance", "capacity", "available"),
            ("announced_repurchase",),
            ("RepurchaseProgram", "MonetaryAmount"),
            ("program", "authorized_amount", "remaining_capacity"),
        ),
        "shareholder_return_activity": (
            ("repurchase", "buyback", "shares", "average price", "cost", "timing", "purchased"),
            ("announced_repurchase",),
            ("RepurchaseProgram", "MonetaryAmount"),
            ("program", "repurchase_amount", "price_or_volume"),
        ),
        "shareholder_return_policy_mix": (
            ("dividend", "policy", "capital return", "shareholder return", "interplay", "drivers"),
            ("announced_repurchase", "declared_dividend"),
            ("RepurchaseProgram", "Dividend"),
            ("repurchase_program", "dividend_program"),
        ),
        "shareholder_return_tax_impact": (
            ("excise tax", "inflation reduction act", "ira", "tax impact"),
            ("announced_repurchase", "declared_dividend"),
            ("RepurchaseProgram", "Dividend"),
            ("tax_factor", "repurchase_program", "dividend_program"),
        ),
    },
}
DEFAULT_INTENTS = {"governance": "governance_board_structure", "financials": "financials_metric_delta", "shareholder_return": "shareholder_return_activity"}
#: Slot hints at run time; a slot without hints is never filled by them.
SLOT_HINTS = {
    "governance_committee_oversight": {"committee": ("committee", "board"), "oversight_roles": ("cio", "ciso", "chief", "officer"), "oversight_topic": ("cyber", "risk", "security")},
    "governance_board_structure": {"board_leadership": ("chair", "lead independent director", "board"), "directors": ("director", "board")},
    "governance_executive_roles": {"executives": ("chief", "executive", "president", "officer"), "roles": ("chief", "head", "president", "director", "counsel")},
    "financials_liquidity_breakdown": {
        "cash": ("cash", "cash equivalents"),
        "investments": ("investment", "treasury"),
        "credit_facility": ("facility", "credit", "revolving"),
        "period": ("202", "q1", "q2", "q3", "q4", "january", "july", "october", "december"),
    },
    "financials_metric_delta": {
        "metric": ("revenue", "income", "cash", "eps", "profit", "margin"),
        "current_period": ("2024", "2023", "2022", "2021", "q1", "q2", "q3", "q4"),
        "prior_period": ("2024", "2023", "2022", "2021", "q1", "q2", "q3", "q4"),
        "value_delta": ("increase", "decrease", "delta"),
    },
    "financials_profitability_trend": {"metric": ("profit", "margin", "income", "eps", "earnings"), "periods": ("2024", "2023", "2022", "2021")},
    "financials_debt_profile": {"debt_instrument": ("note", "debt", "loan"), "period": ("2024", "2023", "2022", "2021")},
    "shareholder_return_authorization": {"program": ("program", "authorization"), "remaining_capacity": ("remaining", "available", "capacity")},
    "shareholder_return_activity": {"program": ("repurchase", "buyback", "program"), "price_or_volume": ("share", "shares", "price")},
    "shareholder_return_policy_mix": {"repurchase_program": ("repurchase", "buyback", "program"), "dividend_program": ("dividend",)},
    "shareholder_return_tax_impact": {"tax_factor": ("tax", "excise"), "repurchase_program": ("repurchase", "buyback", "program"), "dividend_program": ("dividend",)},
}
#: baseline -> (selects a profile, constrained, linked in the sample evaluator, quality-aware).
BASELINES = {
    "question_only_baseline": (None, None, None, None),
    "reference_only_baseline": (None, None, None, None),
    "graph_without_ontology_constraints": (False, False, False, False),
    "graph_with_profile_selection_only": (True, False, False, False),
    "graph_with_profile_plus_constrained_extraction_and_linking": (True, True, True, False),
    "full_minimal_pipeline_with_quality_aware_evidence_selection": (True, True, True, True),
}
# End of fixed values.
