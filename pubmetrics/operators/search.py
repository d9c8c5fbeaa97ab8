"""Record search as a filter over the record table (SRC8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F


def mentions(fields: Sequence[str], term: str) -> Column:
    """The term or phrase occurs in at least one of the fields, ignoring case."""
    wanted = F.lower(F.lit(term))
    return reduce(
        or_, (F.coalesce(F.lower(F.col(f)).contains(wanted), F.lit(False)) for f in fields)
    )


@dataclass(frozen=True)
class Search:
    """A search for whole words: a phrase, or parts joined by and, or, not.

    `Search.phrase("green bond*") & (Search.phrase("sukuk") | ~Search.phrase("bank"))`. A phrase is
    one or more words in a row, in any case, with anything but letters and digits between them; a
    trailing `*` lets its last word go on. `fields` limits a phrase to some of the searched fields.
    """

    how: str
    text: str = ""
    fields: tuple[str, ...] = ()
    parts: tuple[Search, ...] = ()

    @staticmethod
    def phrase(text: str, *fields: str) -> Search:
        if not any(c.isalnum() for c in text):
            raise ValueError(f"no word in {text!r}")
        return Search("phrase", text, fields)

    @staticmethod
    def any_of(*parts: Search | str) -> Search:
        return Search._joined("or", parts)

    @staticmethod
    def all_of(*parts: Search | str) -> Search:
        return Search._joined("and", parts)

    @staticmethod
    def _joined(how: str, parts: Sequence[Search | str]) -> Search:
        if not parts:
            raise ValueError("no parts to join")
        whole = tuple(Search.phrase(p) if isinstance(p, str) else p for p in parts)
        return Search(how, parts=whole)

    def __and__(self, other: Search) -> Search:
        return Search("and", parts=(self, other))

    def __or__(self, other: Search) -> Search:
        return Search("or", parts=(self, other))

    def __invert__(self) -> Search:
        return Search("not", parts=(self,))

    def condition(self, texts: Mapping[str, Column]) -> Column:
        """Whether the texts, made by `word_text`, hold what is searched."""
        if self.how == "phrase":
            lacking = [f for f in self.fields if f not in texts]
            if lacking:
                raise ValueError(f"fields not searched: {', '.join(lacking)}")
            goes_on = self.text.rstrip().endswith("*")
            words = F.concat(F.lit(" "), F.trim(word_text(F.lit(self.text))), F.lit("" if goes_on else " "))
            return reduce(or_, (texts[f].contains(words) for f in self.fields or texts))
        found = [p.condition(texts) for p in self.parts]
        return ~found[0] if self.how == "not" else reduce(and_ if self.how == "and" else or_, found)


def word_text(c: Column) -> Column:
    """The words of a text in order, lowered, each between two blanks; null has none."""
    words = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " ")
    return F.concat(F.lit(" "), words, F.lit(" "))


def holds(fields: Sequence[str], search: Search) -> Column:
    """SRC8: the record's fields hold what is searched, by whole words.

    The words of a field are made once for each record, whatever the number of phrases: they are
    bound as the one element of an array, over which the conditions are a function.
    """
    texts = F.array(F.struct(*(word_text(F.col(f"`{f}`")).alias(f"f{i}") for i, f in enumerate(fields))))
    return F.exists(
        texts, lambda t: search.condition({f: t[f"f{i}"] for i, f in enumerate(fields)})
    )


def search_records(
    df: DataFrame,
    fields: Sequence[str],
    *,
    any_of: Sequence[str] = (),
    all_of: Sequence[str] = (),
    words: Search | None = None,
    limit_to: Mapping[str, Sequence[str]] | None = None,
    min_year: int | None = None,
    max_year: int | None = None,
    year: str = "pub_year",
) -> DataFrame:
    """Records mentioning any / all of the terms, limited to values of given columns and years.

    `any_of` and `all_of` are parts of text, found inside words too; `words` searches whole words. The value and year limits come first and reach the scan; text is only searched in the
    rows they leave. A limit holds for the columns named: language, subject area, type.
    """
    conditions = [F.col(c).isin(list(values)) for c, values in (limit_to or {}).items()]
    if min_year is not None:
        conditions.append(F.col(year) >= min_year)
    if max_year is not None:
        conditions.append(F.col(year) <= max_year)
    if any_of:
        conditions.append(reduce(or_, (mentions(fields, t) for t in any_of)))
    conditions += [mentions(fields, t) for t in all_of]
    if words is not None:
        conditions.append(holds(fields, words))
    return df.filter(reduce(and_, conditions)) if conditions else df
