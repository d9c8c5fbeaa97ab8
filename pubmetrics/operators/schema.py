"""Resolution of varying export headers onto one canonical schema (SCH1-SCH4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

# Candidate column names per logical field, best first.
SEARCH_FIELDS = {
    "eid": ("eid",),
    "doi": ("doi",),
    "title": ("title",),
    "cover_date": ("coverDate", "cover_date"),
    "pub_year": ("pub_year",),
    "creator": ("creator", "dc:creator"),
    "authors": ("author_names",),
    "journal": ("prism:publicationName", "publicationName", "journal", "sourceTitle"),
    "doc_type": ("subtypeDescription",),
    "author_keywords": ("authkeywords", "keywords", "author_keywords"),
    "index_keywords": ("idxterms",),
    "affiliations": ("affilname",),
}

# Candidates of the one-shot CSV export.
EXPORT_FIELDS = {
    "eid": ("EID", "eid"),
    "doi": ("DOI", "doi"),
    "title": ("Title", "dc:title", "title"),
    "cover_date": ("coverDate", "cover_date"),
    "pub_year": ("Year", "pub_year"),
    "creator": (),
    "authors": ("Authors", "author_names", "dc:creator", "creator"),
    "journal": ("Source title", "prism:publicationName", "publicationName"),
    "doc_type": ("Document Type", "subtypeDescription"),
    "author_keywords": ("Author Keywords", "authkeywords", "author_keywords"),
    "index_keywords": ("Index Keywords", "idxterms"),
    "affiliations": ("Affiliations", "affilname"),
}

ORDER_COLUMN = "src_ord"


def resolve_field(names: Sequence[str], candidates: Sequence[str]) -> int | None:
    """SCH1: position of the first candidate present; names match exactly."""
    return next((list(names).index(c) for c in candidates if c in names), None)


def plain_names(names: Sequence[str]) -> list[str]:
    """Trimmed column names, none equal to another but for case.

    Of such a group the names that a field is looked up by stay, else the first; others get a number.
    """
    trimmed = [n.strip() for n in names]
    known = {c for fields in (SEARCH_FIELDS, EXPORT_FIELDS) for cs in fields.values() for c in cs}
    taken: set[str] = set()
    out = list(trimmed)
    for i in sorted(range(len(trimmed)), key=lambda i: (trimmed[i] not in known, i)):
        k = 1
        while out[i].lower() in taken:
            k += 1
            out[i] = f"{trimmed[i]}_{k}"
        taken.add(out[i].lower())
    return out


def canonicalize(
    df: DataFrame,
    fields: Mapping[str, Sequence[str]] = SEARCH_FIELDS,
    *,
    require_year: bool = False,
    keep_other: bool = False,
) -> DataFrame:
    """Select the logical fields as strings; a field with no candidate is null (SCH2).

    Columns are addressed by position, so headers that differ only in case do not clash.
    `require_year` raises when no year or date column exists (SCH3). `keep_other` also keeps
    the columns no field uses, prefixed `src_` where their name is taken.
    """
    names = [c.strip() for c in df.columns]
    found = {field: resolve_field(names, cands) for field, cands in fields.items()}
    if require_year and found.get("pub_year") is None and found.get("cover_date") is None:
        raise ValueError(
            "a year or cover date column is required: one of "
            + ", ".join([*fields.get("pub_year", ()), *fields.get("cover_date", ())])
        )

    positional = df.toDF(*(f"_c{i}" for i in range(len(names))))
    out = []
    if ORDER_COLUMN in names:
        out.append(positional[f"_c{names.index(ORDER_COLUMN)}"].alias(ORDER_COLUMN))
    for field, pos in found.items():
        value = F.lit(None) if pos is None else positional[f"_c{pos}"]
        out.append(value.cast("string").alias(field))
    if keep_other:
        used = {pos for pos in found.values() if pos is not None}
        taken = {ORDER_COLUMN, *(f.lower() for f in fields)}
        for i, name in enumerate(names):
            if i in used or name == ORDER_COLUMN:
                continue
            label = name
            while label.lower() in taken:
                label = f"src_{label}"
            taken.add(label.lower())
            out.append(positional[f"_c{i}"].alias(label))
    return positional.select(*out)
