"""Personal health information: detection, redaction, date shifts; clinical context and headers."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in order of precedence, word lists, weights.
PATTERNS = [
    ("SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("PHONE", r"\b(?:\(\d{3}\)\s?|\d{3}[-\s.]?)?\d{3}[-\s.]?\d{4}\b"),
    ("PHONE", r"\b\+\d{1,3}[-\s.]?\d{3}[-\s.]?\d{3}[-\s.]?\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("DATE", r"\b(0[1-9]|1[0-2])[-/](0[1-9]|[12][0-9]|3[01])[-/]\d{4}\b"),
    ("DATE", r"\b\d{4}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12][0-9]|3[01])\b"),
    ("DATE", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}\b"),
    ("MRN", r"\bMRN\s*[:#]?\s*[A-Z0-9]{6,12}\b"),
    ("MRN", r"\b[A-Z0-9]{6,12}\s*\(MRN\)\b"),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("NAME", r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.)?\s*(?:[A-Z][a-z]+)(?:\s+[A-Z][a-z]+){1,2}\b"),
]
DATE_FORMATS = ["%m/%d/%Y", "%Y/%m/%d", "%m-%d-%Y", "%Y-%m-%d"]
CONTEXT = {
    "negated": ["no", "not", "denies", "without", "negative for", "ruled out", "excluded", "absence of", "free of", "never had", "no evidence of", "no sign of"],
    "historical": ["history of", "prior", "previous", "past", "formerly", "was", "were", "had", "diagnosed with", "treated for"],
    "family": ["family history", "father", "mother", "brother", "sister", "son", "daughter", "parent", "sibling", "mother had", "father had", "runs in the family", "genetic"],
    "hypothetical": ["if", "should", "consider", "rule out", "evaluate for", "suspect", "possible", "potential", "suspected", "question of", "may be", "could be"],
}
HEADERS = {
    "subjective": ["subjective", "history of present illness", "hpi", "chief complaint", "cc", "reason for visit", "review of systems", "ros"],
    "objective": ["objective", "physical exam", "pe", "vitals", "vital signs", "measurements", "exam"],
    "assessment": ["assessment", "assessment and plan", "a/p", "diagnosis", "diagnoses", "impression", "clinical impression", "problem list"],
    "plan": ["plan", "treatment plan", "recommendations", "follow up", "disposition"],
    "history": ["past medical history", "pmh", "social history", "sh", "family history", "fh", "past surgical history", "psh"],
    "medications": ["medications", "current medications", "meds", "active medications", "discharge medications"],
    "allergies": ["allergies", "allergies/intolerances", "all"], "labs": ["labs", "laboratory results", "lab results", "studies"],
    "imaging": ["imaging", "radiology", "studies", "x-ray", "mri", "ct"], "findings": ["findings", "examination"], "impression": ["impression", "conclusion"], "technique": ["technique", "procedure"],
}
SECTION_WEIGHTS = {"IMPRESSION": 1.0, "CONCLUSION": 1.0, "ASSESSMENT": 0.9, "DIAGNOSIS": 0.9, "FINDINGS": 0.8, "RESULTS": 0.8, "SUBJECTIVE": 0.7, "OBJECTIVE": 0.7, "PLAN": 0.6, "RECOMMENDATIONS": 0.6, "TECHNIQUE": 0.3, "METHOD": 0.3, "PROCEDURE": 0.4, "HISTORY": 0.5, "BACKGROUND": 0.4, "OTHER": 0.2}
NEGATION = r"\b(?:no\s+evidence\s+of|rules?\s+out|negative\s+for|denies|without|not\s+(?:present|seen|identified|detected)|absence\s+of|excluded)\b"
AFFIRMATION = r"\b(?:positive\s+for|confirmed|evidence\s+of|consistent\s+with|shows|demonstrates|findings\s+suggest|indicates)\b"
ABBREVIATIONS = {
    "htn": "hypertension", "dm": "diabetes mellitus", "dm2": "type 2 diabetes mellitus", "t2dm": "type 2 diabetes mellitus", "cad": "coronary artery disease", "chf": "congestive heart failure",
    "copd": "chronic obstructive pulmonary disease", "ckd": "chronic kidney disease", "mi": "myocardial infarction", "cva": "cerebrovascular accident", "tia": "transient ischemic attack",
    "dvt": "deep vein thrombosis", "pe": "pulmonary embolism", "uri": "upper respiratory infection", "uti": "urinary tract infection", "gerd": "gastroesophageal reflux disease", "bid": "twice a day",
    "tid": "three times a day", "qid": "four times a day", "qd": "every day", "qhs": "at bedtime", "prn": "as needed", "po": "by mouth", "iv": "intravenous", "im": "intramuscular", "sq": "subcutaneous",
    "mg": "milligrams", "mcg": "micrograms", "g": "grams", "bp": "blood pressure", "hr": "heart rate", "rr": "respiratory rate", "t": "temperature", "wt": "weight", "ht": "height", "bmi": "body mass index",
}

_COMPILED = [(kind, re.compile(p, re.IGNORECASE)) for kind, p in PATTERNS]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted; where matches overlap, that of the earlier pattern (then the earlier match) stays."""
    taken = bytearray(len(text))
    out = []
    for kind, p in _COMPILED:
        for m in p.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((a, b, kind))
    return sorted(out)


def day_offset(patient: str, base: int = 365) -> int:
    return int(hashlib.md5(patient.encode(), usedforsecurity=False).hexdigest(), 16) % (2 * base) - base


def shift_date(value: str, days: int) -> str | None:
    """The date moved by days in its own format; None if it is in none of the known formats."""
    for f in DATE_FORMATS:
        try:
            return (datetime.strptime(value, f) + timedelta(days=days)).strftime(f)
        except (ValueError, OverflowError):
            continue
    return None


def redact(text: str, patient: str | None = None, redacted: frozenset[str] = frozenset(), shift: bool = True, surrogates: bool = True) -> str:
    """Text with each finding replaced. Names are numbered from the last one on, as replacement runs from the end."""
    names: dict[str, str] = {}
    parts, end = [], len(text)
    for a, b, kind in reversed(find(text)):
        value = text[a:b]
        if kind in redacted:
            new = "[REDACTED]"
        elif kind == "DATE" and shift and patient:
            new = shift_date(value, day_offset(patient)) or "[REDACTED_DATE]"
        elif kind == "NAME" and surrogates:
            new = names.setdefault(value.strip().title(), f"[NAME_{len(names) + 1}]")
        else:
            new = f"[REDACTED_{kind}]"
        parts += [text[b:end], new]
        end = a
    return "".join([text[:end], *reversed(parts)])


def context(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """Struct of flags (negated, historical, family, hypothetical) from the characters around [start, end), counted from 0."""
    before = F.substring(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window)))
    after = F.substring(text, end + 1, F.lit(window))
    flags = []
    for name, words in CONTEXT.items():
        p = r"(?i)\b(?:" + "|".join(words) + r")\b"
        flags.append((before.rlike(p) | after.rlike(p)).alias(name))
    return F.struct(*flags)


def section_of(header: Column) -> Column:
    """Canonical section: an equal variant first, else the first one longer than three that is contained; null if none."""
    h = F.regexp_replace(F.lower(F.trim(header)), ":+$", "")
    out = F.lit(None).cast("string")
    for name, words in reversed(HEADERS.items()):
        long = [w for w in words if len(w) > 3]
        out = F.when(reduce(lambda a, b: a | b, [h.contains(w) for w in long], F.lit(False)), name).otherwise(out)
    for name, words in reversed(HEADERS.items()):
        out = F.when(h.isin(*words), name).otherwise(out)
    return out


def section_weight(section: Column, weights: dict[str, float] | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in (weights or SECTION_WEIGHTS).items() for x in kv])
    return F.coalesce(F.element_at(m, F.upper(F.trim(section))), F.lit(0.2))


def negation_factor(content: Column) -> Column:
    c = F.lower(content)
    return F.when(c.rlike(NEGATION), 0.3).when(c.rlike(AFFIRMATION), 1.5).otherwise(1.0)


def expand_abbreviation(token: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(token)), token)
