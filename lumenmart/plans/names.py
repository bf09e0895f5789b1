"""What names say: finding a column that a question means, labels, keys and marks, personal data, and text that may go into an expression.

All of it looks at names only and runs on the driver; its size is that of a schema.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Unsafe(ValueError):
    """Text that must not become part of a query."""


def plain(name: str) -> str:
    """Letters and digits only, in lower case."""
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def words(name: str) -> list[str]:
    """The words of a name: cut at case changes and separators."""
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).lower())


def label(name: str) -> str:
    """paidAmount and paid_amount are both Paid Amount."""
    return " ".join(w.title() for w in words(name))


def measure_label(metric: str, percent: bool = False) -> str:
    """What a metric is called: its column without the function; shares all have one name."""
    if percent or re.search(r"percent|share", metric.lower()):
        return "Percentage Share"
    inner = re.search(r"\(([^)]+)\)", metric)
    token = re.sub(r"(?i)\bdistinct\b|^\s*(sum|avg|mean|count|total|min|max)[_ ]", "", inner[1] if inner else metric)
    return label(token.strip(" *")) or "Value"


def find(name: str, columns: Sequence[str]) -> str | None:
    """The column of that name: as it is written, else whatever its case."""
    return name if name in columns else next((c for c in columns if c.lower() == name.lower()), None)


def resolve(term: str, labels: Mapping[str, str]) -> str | None:
    """The column that a term means, by the labels of columns: the same text, the same letters, or the label whose words all occur in the term, the longest."""
    lower = {k.lower(): v for k, v in labels.items()}
    if term.lower() in lower:
        return lower[term.lower()]
    for name, column in lower.items():
        if plain(name) == plain(term):
            return column
    said = set(words(term))
    within = [(len(set(words(k))), -n, v) for n, (k, v) in enumerate(labels.items()) if words(k) and set(words(k)) <= said]
    return max(within)[2] if within else None


#: Likeness that two names need, and that of a name within another.
LIKE, WITHIN = 0.6, 0.9


def resolve_group(term: str, labels: Mapping[str, str], tables: Mapping[str, str] | None = None, cuts: Sequence[str] = ()) -> str | None:
    """The column to partition by, or None: never one that is not there. Misspelt terms go to the likest label, table (by the column that shows it) or cut."""
    if (found := resolve(term, labels)) is not None:
        return found
    t = plain(term)
    if not t:
        return None
    like = lambda x: SequenceMatcher(None, t, plain(x)).ratio()
    scored = [(like(k), v) for k, v in labels.items()]
    scored += [(max(like(k), WITHIN) if t in plain(k) or plain(k) in t else like(k), v) for k, v in (tables or {}).items()]
    for options in (scored, [(like(c), c) for c in cuts]):
        if options and (best := max(options, key=lambda o: o[0]))[0] >= LIKE:
            return best[1]
    return None


# Scores of columns for the words of a question
def term_score(name: str, description: str, samples: Sequence[str], terms: Sequence[str]) -> float:
    """How well a column fits a question's terms: best by name (0.55 and up), then by description (0.5), then by values (0.45); 0.95 at most."""
    wanted = {t.lower() for t in terms}
    share = lambda have: len(wanted & set(have)) / len(wanted) if wanted else 0.0
    by = ((0.55, words(name)), (0.5, words(description)), (0.45, [w for s in samples for w in words(str(s))]))
    scores = [base + 0.4 * share(have) for base, have in by if share(have) > 0]
    return round(min(0.95, max(scores, default=0.0)), 4)


def temporal_anchor(question: str, columns: Sequence[tuple[str, str]], preferred: str | None = None) -> tuple[str, str] | None:
    """The date (table, column) that a question is about: the one whose words it names most, else that of the preferred table, else the only one; None if two would do."""
    said = set(words(question))
    scores = [(len(said & set(words(c))), (t, c)) for t, c in columns]
    best = max((s for s, _ in scores), default=0)
    for options in ([x for s, x in scores if s == best and best > 0], [x for x in columns if x[0] == preferred], list(columns)):
        if len(options) == 1:
            return options[0]
        if len(options) > 1 and options is not columns and preferred and len(own := [x for x in options if x[0] == preferred]) == 1:
            return own[0]
        if options:
            return None
    return None


# Keys and marks
#: Columns that say when a row was changed, or made; in this order.
CHANGED, MADE = ("modifieddate", "modified_at", "updateddate", "updated_at"), ("insertdate", "inserted_at", "createddate", "created_at")


def natural_key(columns: Sequence[str], table: str) -> str | None:
    """The column that names the table and ends in id; else id itself."""
    named = [c for c in columns if c.lower().endswith("id") and table.lower() in c.lower()]
    return (named or [c for c in ("ID", "Id", "id") if c in columns] or [None])[0]


def own_key(schema: T.StructType, table: str, declared: Sequence[str] = ()) -> list[str]:
    """The columns to merge by: those declared, else id, <table>_id or the singular's; another table's key is none."""
    if declared:
        return list(declared)
    stem = table.rpartition(".")[2].lower()
    for wanted in ("id", f"{stem}_id", *([f"{stem[:-1]}_id"] if stem.endswith("s") else [])):
        if (c := find(wanted, schema.names)) is not None:
            return [c]
    return []


def changed_at(columns: Sequence[str]) -> str | None:
    """The column that says when a row was changed, else when it was made."""
    return next((c for names in (CHANGED, MADE) for c in columns if c.lower() in names), None)


def mark_column(schema: T.StructType) -> str | None:
    """A column that grows with new rows: a time that speaks of changes, else of making, else any named as a time, else a counter."""
    ranked = []
    for f in schema.fields:
        timely, n = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)), f.name.lower()
        if timely:
            order = [any(w in n for w in ("updat", "modif", "chang")), any(w in n for w in ("creat", "insert", "load")), n.endswith(("_at", "_ts", "date", "_time"))]
            if any(order):
                ranked.append((order.index(True), f.name))
        elif isinstance(f.dataType, T.IntegralType) and any(w in n for w in ("seq", "version", "offset", "rowversion")):
            ranked.append((3, f.name))
    return min(ranked, key=lambda r: r[0])[1] if ranked else None


def velocity(latency_seconds: float | None, continuous: bool) -> str:
    """How a source is read: as a batch, all that is there, or as it comes."""
    if latency_seconds is None or latency_seconds >= 3600:
        return "batch"
    return "stream" if continuous and latency_seconds < 60 else "available_now"


# Personal data, by name
#: What columns that identify a person are called, by category; whole names, case does not count.
PERSONAL = {
    "name": (r"(first|last|middle|full|maiden|given|sur|patient|member|subscriber|beneficiary|guarantor|provider|guardian|dependent|insured|policy[_ ]?holder)[_ ]?name",),
    "ssn": (r"ssn([_ ]?(no|num|number))?", r"social[_ ]?security([_ ]?(no|num|number))?"),
    "date_of_birth": (r"dob", r"date[_ ]?of[_ ]?birth", r"birth[_ ]?date"),
    "individual_linked_date": (r"(date[_ ]?of[_ ]?)?death([_ ]?date)?", r"deceased([_ ]?date)?"),
    "phone": (r"(phone|mobile|cell|fax)([_ ]?(no|num|number))?",),
    "email": (r"e[_ ]?mail([_ ]?address)?",),
    "address": (r"address(_?line\d*)?", r"street", r"city", r"zip([_ ]?code)?", r"postal([_ ]?code)?"),
    "medical_record_number": (r"mrn", r"medical[_ ]?record([_ ]?(no|num|number))?"),
    "account_number": (r"account([_ ]?(no|num|number))?", r"acct([_ ]?(no|num|number))?"),
    "health_plan_beneficiary": (
        r"medicaid([_ ]?id)?", r"medicare([_ ]?id)?", r"beneficiary([_ ]?id)?", r"subscriber([_ ]?id)?", r"health[_ ]?plan([_ ]?id)?", r"policy([_ ]?(no|num|number))?",
    ),
    "certificate_or_license": (r"(license|licence|certificate)([_ ]?(no|num|number))?", r"npi"),
    "device_identifier": (r"device([_ ]?(id|serial))?", r"serial([_ ]?(no|num|number))?"),
    "ip_address": (r"ip([_ ]?address)?",),
    "url": (r"url", r"website"),
    "vehicle_identifier": (r"vin", r"(license[_ ]?)?plate([_ ]?(no|num|number))?"),
    "biometric": (r"(fingerprint|biometric|retina|voiceprint)([_ ]?id)?",),
}
#: What columns of card and bank data are called.
CARD = {
    "primary_account_number": (r"pan", r"primary[_ ]?account[_ ]?number", r"(credit[_ ]?|debit[_ ]?)?card[_ ]?(no|num|number)", r"cc[_ ]?(no|num|number)", r"credit[_ ]?card"),
    "card_verification": (r"cvv2?", r"cvc2?", r"cid", r"card[_ ]?verification([_ ]?(code|value|no|num|number))?", r"security[_ ]?code"),
    "card_expiry": (r"card[_ ]?expir(y|ation)([_ ]?(date|month|year))?", r"exp[_ ]?(month|year)"),
    "cardholder_name": (r"card[_ ]?holder([_ ]?name)?",),
    "card_track_data": (r"track[12]?[_ ]?data", r"magstripe([_ ]?data)?"),
    "bank_account": (r"iban", r"routing[_ ]?(no|num|number)", r"bank[_ ]?account([_ ]?(no|num|number))?", r"(aba|swift|bic)([_ ]?(code|no|num|number))?"),
}
#: A name and these dates are personal in tables of persons only, which are told by these words in their names.
OF_PERSONS = {"name": (r"name",), "individual_linked_date": (r"(admi(t|ssion)|discharge|service|encounter|visit)([_ ]?date)?",)}
PERSONS = (
    "patient", "member", "subscriber", "beneficiary", "guarantor", "person", "people", "individual", "employee", "staff", "provider", "physician", "doctor", "nurse", "clinician", "customer", "client", "contact", "user",
    "guardian", "dependent", "policyholder", "insured",
)


def of_persons(table: str) -> bool:
    """Whether a table, by the last part of its name or path, is one of persons."""
    last = re.sub(r"\.\w+$", "", re.split(r"[/\\]", table.strip().lower())[-1])
    return any(word in last for word in PERSONS)


def category(name: str, person: bool | str = False) -> str | None:
    """The kind of personal or card data that a column of that name, or the leaf of that path, holds.

    person: whether its table is one of persons, or the table's name; only there names and dates of stays are personal."""
    lists = [PERSONAL, CARD] + ([OF_PERSONS] if (of_persons(person) if isinstance(person, str) else person) else [])
    tried = dict.fromkeys((name.strip(), name.strip().rpartition(".")[2]))
    return next((kind for n in tried for known in lists for kind, shapes in known.items() if any(re.fullmatch(x, n, re.I) for x in shapes)), None)


def sensitive(name: str, person: bool | str = True) -> bool:
    return category(name, person) is not None


# Text that becomes an expression
#: What an expression may not hold.
MARKS = (";", "--", "/*", "*/")
STATEMENTS = {
    "alter", "attach", "call", "copy", "create", "delete", "detach", "drop", "exec", "execute", "export", "grant", "insert", "install", "load", "merge", "pragma", "revoke", "truncate", "update",
    "vacuum",
}
#: Functions that formulas may call.
VOCABULARY = {"avg", "coalesce", "count", "date_diff", "datediff", "floor", "greatest", "lower", "max", "min", "month", "nullif", "percentile", "round", "sum", "upper"}


def identifier(name: str) -> str:
    """name, if it is a plain identifier."""
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise Unsafe(f"no identifier: {name!r}")
    return name


def safe_text(text: str) -> str:
    """text, if it holds no end of a statement, comment or word that changes data, outside of quoted literals."""
    if not isinstance(text, str):
        raise Unsafe(f"no text: {text!r}")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    held = [m for m in MARKS if m in bare] + sorted(STATEMENTS & set(re.findall(r"[a-z_]+", bare.lower())))
    if held or bare.count("'") % 2:
        raise Unsafe(f"{held or 'an open quote'} in {text!r}")
    return text


def safe_expr(text: str) -> Column:
    return F.expr(safe_text(text))


def formula(text: str, columns: Sequence[str]) -> Column:
    """A formula over known columns with the accepted functions only."""
    bare = re.sub(r"'(?:[^']|'')*'", "", safe_text(text))
    unknown = {f.lower() for f in re.findall(r"([A-Za-z_]\w*)\s*\(", bare)} - VOCABULARY
    held = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", re.sub(r"[A-Za-z_]\w*\s*\(", "(", bare))} - {c.lower() for c in columns}
    held -= {"and", "or", "not", "null", "is", "in", "between", "case", "when", "then", "else", "end", "true", "false", "distinct", "like", "day", "hour", "month", "year", "as", "date"}
    if unknown or held:
        raise Unsafe(f"{sorted(unknown | held)} not known in {text!r}")
    return F.expr(text)
