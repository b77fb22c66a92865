"""Closed vocabularies of the document library and what normalises values to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, labels, aliases, keywords and signals that results depend on.
UNASSIGNED = "Unassigned"
PRIORITIES = ("High", "Medium", "Low")
FILE_TYPES = ("PDF", "DOCX", "TXT", "IMAGE")
DOCUMENT_TYPES = (
    "Engineering Drawing", "Maintenance Job Card", "Incident Report", "Invoice", "Purchase Order", "Regulatory Directive", "Safety Circular",
    "Environmental Study", "HR Policy", "Legal Opinion", "Board Minutes", "Tender / Contract", "Training Material", "Technical Report", "Correspondence", "Other",
)
STATUS_LABELS = {
    "queued": "Queued", "processing": "Processing", "ocr_processing": "OCR Processing", "ai_analysis": "AI Analysis",
    "analysis_complete": "AI Analysis Complete", "failed": "Failed",
}
STATUS_ALIASES = {
    "processing": "processing", "ocr processing": "ocr_processing", "ocr_processing": "ocr_processing", "ai analysis": "ai_analysis",
    "ai analysis complete": "analysis_complete", "analysis complete": "analysis_complete", "complete": "analysis_complete",
    "completed": "analysis_complete", "failed": "failed", "queued": "queued",
}
DEPARTMENT_ALIASES = {
    "civil": "Civil / Track", "track": "Civil / Track", "civil/track": "Civil / Track", "signalling": "Signalling & Telecom",
    "signaling": "Signalling & Telecom", "s&t": "Signalling & Telecom", "telecom": "Signalling & Telecom", "human resources": "HR",
    "information technology": "IT", "stores": "Procurement", "purchase": "Procurement", "accounts": "Finance",
}
PRIORITY_ALIASES = {
    "urgent": "High", "critical": "High", "p1": "High", "normal": "Medium", "moderate": "Medium", "p2": "Medium",
    "minor": "Low", "informational": "Low", "p3": "Low",
}
DEPARTMENT_KEYWORDS = {
    "Operations": ("train operation", "timetable", "headway", "station controller", "service", "ridership", "platform", "depot control", "train availability", "ots", "operations control centre", "occ", "punctuality", "revenue service"),
    "Rolling Stock": ("rolling stock", "bogie", "traction motor", "trainset", "coach", "brake", "maximo", "job card", "overhaul", "wheel", "pantograph", "hvac unit", "propulsion", "car body", "preventive maintenance"),
    "Civil / Track": ("viaduct", "track", "ballast", "alignment", "bridge", "civil works", "station building", "structural", "geometry", "tamping", "rail weld", "concrete", "girder"),
    "Signalling & Telecom": ("signalling", "signaling", "cbtc", "interlocking", "telecom", "atp", "ato", "axle counter", "scada", "radio", "fibre", "fiber optic", "communication system"),
    "Electrical": ("traction power", "ohe", "overhead equipment", "substation", "33kv", "electrical", "transformer", "ups", "power supply", "lighting", "earthing", "breaker"),
    "Safety": ("safety", "incident", "accident", "hazard", "near miss", "cmrs", "commissioner of metro rail safety", "risk assessment", "emergency", "fire", "evacuation", "safety circular", "audit non-conformity", "ppe", "inspection"),
    "Finance": ("invoice", "payment", "budget", "expenditure", "gst", "audit", "financial", "cash flow", "accounts", "reimbursement", "fare revenue", "cost centre", "bill"),
    "Procurement": ("tender", "purchase order", "vendor", "supplier", "quotation", "rfp", "bid", "contract award", "spare parts", "procurement", "eoi", "emd", "delivery schedule"),
    "HR": ("employee", "staff", "recruitment", "training", "leave policy", "payroll", "appraisal", "human resources", "attendance", "transfer order", "refresher training", "manpower"),
    "Legal": ("legal", "litigation", "court", "arbitration", "agreement", "clause", "compliance notice", "affidavit", "counsel", "writ petition", "memorandum of understanding", "indemnity"),
    "Projects": ("project", "corridor", "phase ii", "phase 2", "extension", "milestone", "dpr", "detailed project report", "construction", "commissioning", "new depot", "work package"),
    "IT": ("software", "application", "database", "server", "network", "cyber", "erp", "sharepoint", "machine learning", "data analytics", "api", "system integration", "unified namespace", "iot", "dashboard", "algorithm", "neural network", "model training", "python"),
}
DOCUMENT_TYPE_KEYWORDS = {
    "Invoice": ("invoice", "tax invoice", "bill no", "amount payable", "gstin"),
    "Purchase Order": ("purchase order", "po number", "po no", "supply order"),
    "Maintenance Job Card": ("job card", "work order", "maximo", "maintenance schedule"),
    "Incident Report": ("incident report", "near miss", "accident report", "occurrence"),
    "Regulatory Directive": ("ministry of housing", "mohua", "commissioner of metro rail safety", "directive", "gazette", "statutory", "circular no", "regulation"),
    "Safety Circular": ("safety circular", "safety bulletin", "safety advisory"),
    "Environmental Study": ("environmental impact", "eia", "pollution control", "green audit"),
    "HR Policy": ("hr policy", "leave policy", "code of conduct", "employee handbook", "human resources", "refresher training", "training calendar", "payroll", "hr circular", "appraisal"),
    "Legal Opinion": ("legal opinion", "counsel opinion", "legal advice", "arbitration award"),
    "Board Minutes": ("minutes of the meeting", "board meeting", "agenda item", "resolved that"),
    "Tender / Contract": ("tender document", "nit", "contract agreement", "scope of work", "bid document"),
    "Engineering Drawing": ("drawing no", "revision", "scale 1:", "general arrangement", "as-built"),
    "Training Material": ("module", "unit", "syllabus", "lecture", "chapter", "learning outcome", "tutorial"),
    "Technical Report": ("technical report", "analysis report", "findings", "methodology", "test report", "technical note", "architecture note", "design note", "inspection report", "quarterly report", "recommendation"),
    "Correspondence": ("dear sir", "with reference to", "yours faithfully", "subject:", "notice", "station notice", "for information"),
}
HIGH_SIGNALS = ("urgent", "immediate", "immediately", "critical", "safety critical", "non-compliance", "penalty", "deadline", "escalate", "emergency", "accident", "failure", "shutdown", "statutory", "mandatory", "within 24 hours", "within 48 hours", "top priority", "show cause")
MEDIUM_SIGNALS = ("action required", "please ensure", "review", "submit", "schedule", "follow up", "reminder", "kindly arrange", "compliance", "due")
ACTION_SIGNALS = ("shall", "must", "is required to", "are required to", "please ensure", "action required", "to be completed", "submit", "ensure that", "arrange", "responsible for", "needs to", "should be", "is directed to", "comply", "is requested to", "are requested to", "requested to", "is due", "due within", "we advise", "advised to", "required to")
RISK_SIGNALS = ("risk", "penalty", "non-compliance", "non compliance", "delay", "failure", "hazard", "breach", "litigation", "shortfall", "defect", "unsafe", "escalation", "shutdown", "liability", "overrun")
COMPLIANCE_SIGNALS = ("commissioner of metro rail safety", "cmrs", "ministry of housing", "mohua", "statutory", "regulation", "audit", "gazette", "compliance", "mandatory", "directive", "circular", "gst", "rti")
ACRONYMS = ("CMRS", "MOHUA", "OHE", "HR", "IT", "CBTC", "ATP", "ATO", "SCADA", "NIT", "EMD", "GST", "DPR", "UNS", "IOT", "OCC", "PSD", "AC", "DC", "UPS", "RFP", "EOI", "PO", "TS", "JC", "INV", "ERP", "API", "SOP", "PPE")
MINOR_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")
STOP_WORDS = (
    "the", "and", "for", "are", "with", "that", "this", "from", "have", "has", "was", "were", "will", "shall", "been", "they", "their", "there", "which",
    "into", "such", "also", "any", "all", "not", "but", "can", "may", "our", "its", "per", "you", "your", "about", "these", "those", "than", "then",
    "when", "what", "who", "whom", "how", "each", "other", "some", "more", "most", "over", "under", "between", "during", "after", "before", "above",
    "below", "upon", "within", "including", "page", "figure", "table",
)
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: In the order in which a first date is looked for.
DATE_PATTERNS = (
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})\s+\d{{4}}\b",
    rf"(?i)\b(?:{_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",
    r"(?i)\bwithin\s+\d{1,3}\s+(?:days|weeks|months|hours|working days)\b",
)
# End of the fixed values.

DEPARTMENTS = tuple(DEPARTMENT_KEYWORDS)
STATUSES = tuple(STATUS_LABELS)


def one_of(value: Column, table: dict[str, str]) -> Column:
    """Value of the table, null for a key that it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def _folded(names) -> dict[str, str]:
    return {n.lower(): n for n in names}


def normalise_department(value: Column) -> Column:
    return F.coalesce(one_of(F.lower(F.trim(value)), {**DEPARTMENT_ALIASES, **_folded(DEPARTMENTS)}), F.lit(UNASSIGNED))


def normalise_priority(value: Column) -> Column:
    return F.coalesce(one_of(F.lower(F.trim(value)), {**PRIORITY_ALIASES, **_folded(PRIORITIES)}), F.lit("Medium"))


def normalise_document_type(value: Column) -> Column:
    """Unknown types pass, cut at 60 characters."""
    cut = F.left(F.trim(value), F.lit(60))
    return F.coalesce(one_of(F.lower(F.trim(value)), _folded(DOCUMENT_TYPES)), F.when(cut != "", cut), F.lit("Other"))


def status_label(value: Column) -> Column:
    return F.coalesce(one_of(value, STATUS_LABELS), value)


def status_of(name: str | None) -> str | None:
    """Status of a value or label, None if unknown; while a query is planned."""
    clean = (name or "").strip().lower()
    return clean if clean in STATUS_LABELS else STATUS_ALIASES.get(clean)
