"""Small dimension tables: clause groups, keyword lists, core types (fixed values)."""

from __future__ import annotations

CLAUSE_GROUPS = {
    "basic_info": ["DOCUMENT_NAME", "PARTIES", "AGREEMENT_DATE", "EFFECTIVE_DATE"],
    "term_termination": ["EXPIRATION_DATE", "RENEWAL_TERM", "NOTICE_PERIOD_TO_TERMINATE_RENEWAL", "TERMINATION_FOR_CONVENIENCE", "POST_TERMINATION_SERVICES"],
    "governance": ["GOVERNING_LAW", "ANTI_ASSIGNMENT", "CHANGE_OF_CONTROL"],
    "competition": ["NON_COMPETE", "EXCLUSIVITY", "NO_SOLICIT_OF_CUSTOMERS", "COMPETITIVE_RESTRICTION_EXCEPTION", "NO_SOLICIT_OF_EMPLOYEES", "NON_DISPARAGEMENT"],
    "commercial": ["MOST_FAVORED_NATION", "ROFR_ROFO_ROFN", "REVENUE_PROFIT_SHARING", "PRICE_RESTRICTIONS", "MINIMUM_COMMITMENT", "VOLUME_RESTRICTION"],
    "ip": ["IP_OWNERSHIP_ASSIGNMENT", "JOINT_IP_OWNERSHIP", "LICENSE_GRANT", "NON_TRANSFERABLE_LICENSE", "AFFILIATE_LICENSE_LICENSOR", "AFFILIATE_LICENSE_LICENSEE", "UNLIMITED_ALL_YOU_CAN_EAT_LICENSE", "IRREVOCABLE_OR_PERPETUAL_LICENSE", "SOURCE_CODE_ESCROW"],
    "liability": ["UNCAPPED_LIABILITY", "CAP_ON_LIABILITY", "LIQUIDATED_DAMAGES", "WARRANTY_DURATION", "INSURANCE", "COVENANT_NOT_TO_SUE", "AUDIT_RIGHTS"],
    "other": ["THIRD_PARTY_BENEFICIARY"],
}
CLAUSES = [c for group in CLAUSE_GROUPS.values() for c in group]
CORE_TYPES = ["PARTY", "DOC_NAME", "AGMT_DATE"]
SEGMENT_KEYWORDS = {
    "Party": ["contratante", "contratada", "parte", "party", "buyer", "seller"],
    "CONTRATANTE": ["contratante", "parte", "empresa"],
    "CONTRATADA": ["contratada", "prestadora", "fornecedor"],
    "Date": ["data", "date", "assinatura", "signed"],
    "DATA_CONTRATO": ["data", "celebrado", "firmado"],
    "CNPJ": ["cnpj", "inscrita", "cadastro"],
    "VALOR": ["valor", "preço", "r$", "reais"],
    "PRAZO": ["prazo", "vigência", "meses", "anos"],
    "FORO": ["foro", "comarca", "jurisdição"],
}


def clause_groups(spark):
    """(pos, group, type) of all clauses."""
    rows = [(g, t) for g, ts in CLAUSE_GROUPS.items() for t in ts]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, `group` string, type string")
