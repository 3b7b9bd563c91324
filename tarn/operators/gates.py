"""The screening gates, as expressions in the order in which they are asked, and the verdicts they give."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import money
from tarn.functions.text import SPACE_AT_ENDS, ascii_text, let, place_text, strip, terms

VERDICT = "struct<verdict: string, summary: string, title_mismatch: string>"


@dataclass(frozen=True)
class Profile:
    """What the reader looks for. Blank lists switch their gate off."""

    roles: str = ""
    role_synonyms: str = ""
    title_keywords: str = ""
    compensation: str = ""
    locations: str = ""
    locations_include: tuple[str, ...] = ()
    locations_exclude: tuple[str, ...] = ()
    compensation_min: float | None = None
    compensation_currency: str = "USD"
    compensation_period: str = "year"
    negative_keywords: str = ""
    extra: dict = field(default_factory=dict)

    def has_content(self) -> bool:
        return any(x.strip() for x in (self.roles, self.role_synonyms, self.title_keywords, self.compensation, self.locations))


def _verdict(summary: Column, mismatch: Column) -> Column:
    return F.struct(F.lit("mismatch").alias("verdict"), summary.alias("summary"), mismatch.cast("string").alias("title_mismatch")).cast(VERDICT)


# What a profile declares is normalised here, once: Spark would not fold it, and do it again for every row.


def _stripped(s: str) -> str:
    return re.sub(SPACE_AT_ENDS, "", s, flags=re.ASCII)


def _ascii(s: str) -> str:
    return re.sub("[^a-z0-9]+", " ", s.lower()).strip(" ")


def _first_contained(text: Column, found: list[tuple[str, str]]) -> Column:
    """Of (what text may contain, what is said of it) the first; null if there is none."""
    return reduce(lambda rest, f: F.when(text.contains(f[0]), f[1]).otherwise(rest), reversed(found), F.lit(None).cast("string"))


def _places(values: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(_ascii(re.sub("[.'’]", "", t.lower())), t) for t in map(_stripped, values) if t]


def blocked_keyword(title: Column, negative: str) -> Column:
    """The first declared keyword that the title contains, or null."""
    declared = [k for k in (_stripped(t).lower() for t in re.split("[\n,]", negative or "")) if k]
    return let(F.lower(title), lambda low: _first_contained(low, [(k, k) for k in declared]))


def blocked_verdict(title: Column, keyword: Column) -> Column:
    said = F.concat(F.lit('contains the blocked keyword "'), keyword, F.lit('".'))
    return _verdict(F.concat(F.lit('Held back before the AI judge: "'), title, F.lit('" '), said), F.concat(F.lit("Title "), said))


def title_wanted(title: Column, wanted: str) -> Column:
    """Whether the title contains a keyword; substrings count, and so does a title without any word."""
    found = [k for k in map(_ascii, re.split("[,;\n]", wanted or "")) if k]
    # Entries have letters, digits and single spaces only; no text at all is the first choice.
    return ascii_text(title).rlike("|".join([r"\A\z", *found])) if found else F.lit(True)


def title_verdict(title: Column, wanted: str) -> Column:
    said = F.concat(F.lit('"'), title, F.lit(f'" doesn\'t contain any of the profile\'s declared title keywords ({wanted})'))
    return _verdict(F.concat(F.lit("Held back before the AI judge: "), said, F.lit(".")), F.concat(said, F.lit(" — rejected by the keyword filter ahead of the AI judge.")))


def location_decision(location: Column, profile: Profile) -> Column:
    """struct<ok, kind, term>: an excluded term beats an included one; an unstated place passes."""
    include, exclude = _places(profile.locations_include), _places(profile.locations_exclude)

    def decided(text: Column) -> Column:
        hit = _first_contained(text, exclude)
        kind = F.when(hit.isNotNull() & (text != ""), "excluded")
        if include:
            kind = kind.when(_first_contained(text, include).isNull() & (text != ""), "not-included")
        return F.struct(kind.isNull().alias("ok"), kind.alias("kind"), F.when(kind == "excluded", hit).alias("term"))

    return let(place_text(strip(F.coalesce(location, F.lit("")))), decided)


def location_verdict(title: Column, location: Column, decision: Column, profile: Profile) -> Column:
    shown = F.coalesce(F.nullif(strip(location), F.lit("")), F.lit("unstated"))
    head = F.concat(F.lit('Held back before the AI judge: "'), title, F.lit('" is in '), shown)
    listed = ", ".join(s.strip() for s in profile.locations_include if s.strip())
    out = F.concat(head, F.lit(', which matches your excluded location "'), decision["term"], F.lit('".'))
    missing = F.concat(head, F.lit(f", which isn't one of your included locations ({listed})."))
    return _verdict(F.when(decision["kind"] == "excluded", out).otherwise(missing), F.lit(None))


def pay_ok(compensation: Column, profile: Profile) -> Column:
    """False only if the stated ceiling, in a currency that compares, is below the floor."""
    if not profile.compensation_min or profile.compensation_min <= 0:
        return F.lit(True)
    floor = money.floor_per_year(F.lit(float(profile.compensation_min)), F.lit(profile.compensation_period))
    return let(
        money.pay(compensation),
        lambda stated: stated.isNull() | (F.coalesce(stated["currency"], F.lit(profile.compensation_currency)) != profile.compensation_currency) | (stated["max_per_year"] >= floor),
    )


def pay_verdict(title: Column, compensation: Column, profile: Profile) -> Column:
    target = profile.compensation.strip() or "your stated floor"
    return _verdict(F.concat(F.lit('Held back before the AI judge: "'), title, F.lit('" states pay of '), strip(compensation), F.lit(f", below your target of {target}.")), F.lit(None))


def pre_filter(title: Column, location: Column, compensation: Column, profile: Profile) -> Column:
    """The verdict of the first gate that fails, in the order title, location, pay; null if all pass."""
    pay = F.when(~pay_ok(compensation, profile), pay_verdict(title, compensation, profile))
    later = let(location_decision(location, profile), lambda d: F.when(~d["ok"], location_verdict(title, location, d, profile)).otherwise(pay))
    return F.when(~title_wanted(title, profile.title_keywords), title_verdict(title, profile.title_keywords)).otherwise(later)


def is_thin(company: Column, location: Column, compensation: Column) -> Column:
    return F.concat_ws("", company, location, compensation) == ""


def within_scope(title: Column, roles: str, synonyms: str) -> Column:
    """Whether the title contains a declared role or is contained in one."""
    known = F.concat(terms(F.lit(roles)), terms(F.lit(synonyms)))
    return let(ascii_text(title), lambda text: (F.size(known) == 0) | (text == "") | F.exists(known, lambda k: text.contains(k) | k.contains(text)))


def thin_backstop(verdict: Column, title: Column, company: Column, location: Column, compensation: Column, profile: Profile) -> Column:
    """A thin posting whose title is out of scope is a mismatch, whatever the judge says."""
    said = F.concat(
        F.lit('No company, location, or description was available to judge from, and "'), title,
        F.lit('" doesn\'t textually match any declared target role/equivalent — held back rather than guessed.'),
    )
    hold = verdict["title_mismatch"].isNull() & is_thin(company, location, compensation) & ~within_scope(title, profile.roles, profile.role_synonyms)
    return F.when(hold, F.struct(F.lit("mismatch").alias("verdict"), verdict["summary"].alias("summary"), said.alias("title_mismatch")).cast(VERDICT)).otherwise(verdict.cast(VERDICT))


def location_gate_active(profile: Profile) -> bool:
    return any(s.strip() for s in (*profile.locations_include, *profile.locations_exclude))


def pay_gate_active(profile: Profile) -> bool:
    return bool(profile.compensation_min and profile.compensation_min > 0)
