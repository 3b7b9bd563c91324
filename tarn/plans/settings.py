"""Settings and the profile: one small record, handled on the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

SECRETS = ("llm_api_key", "telegram_bot_token", "tavily_api_key")
CURRENCIES, PERIODS = ("USD", "EUR", "GBP", "INR"), ("year", "month")
TAGGED = ("roles", "role_synonyms", "title_keywords")
_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹"}


def tags(value: str | None) -> list[str]:
    return [t.strip() for t in re.split("[,;\n]", value or "") if t.strip()]


def tag_key(value: str) -> str:
    return " ".join(value.lower().split())


def clean_tags(values) -> list[str]:
    """Trimmed, without delimiters, the first of those equal but for case."""
    out: dict[str, str] = {}
    for value in values if isinstance(values, (list, tuple)) else ():
        if isinstance(value, str):
            text = " ".join(re.sub("[,;\n]", " ", value).split())
            if text:
                out.setdefault(text.lower(), text)
    return list(out.values())


def clean_amount(value) -> int | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value < float("inf"):
        return None
    return int(value + 0.5)


def compact(amount: int, currency: str) -> str:
    units = ((10_000_000, "Cr"), (100_000, "L"), (1000, "K")) if currency == "INR" else ((1_000_000, "M"), (1000, "K"))
    for unit, letter in units:
        if amount >= unit:
            tenths = (amount * 10 + unit // 2) // unit
            return f"{_SIGNS[currency]}{tenths // 10}{f'.{tenths % 10}' if tenths % 10 else ''}{letter}"
    return f"{_SIGNS[currency]}{amount}"


def pay_prose(low: int | None, high: int | None, currency: str, period: str) -> str:
    unit = "/ mo" if period == "month" else "/ yr"
    if low and high:
        return f"{compact(low, currency)} – {compact(high, currency)} {unit}"
    return f"From {compact(low, currency)} {unit}" if low else f"Up to {compact(high, currency)} {unit}" if high else ""


def location_prose(include: list[str], exclude: list[str]) -> str:
    return ". ".join(x for x in (f"Only: {', '.join(include)}" if include else "", f"Never: {', '.join(exclude)}" if exclude else "") if x)


def resolved(table: Mapping, environment: Mapping | None = None) -> dict:
    """The settings of a run: a variable of the environment wins where it is not blank."""
    env = os.environ if environment is None else environment
    return {k: (env.get(k.upper(), "").strip() or (v if v is not None else "")) for k, v in table.items()}


def masked(settings: Mapping) -> dict:
    """What may be shown: no secret, only whether it is set."""
    shown = {k: v for k, v in settings.items() if k not in SECRETS}
    return shown | {f"has_{k}": bool(settings.get(k)) for k in SECRETS}


def updated(settings: Mapping, patch: Mapping) -> dict:
    """settings after a patch: the profile is replaced as a whole and its prose rebuilt, secrets only change
    to something."""
    out = dict(settings)
    for key, value in patch.items():
        if key in SECRETS:
            if isinstance(value, str) and value.strip():
                out[key] = value.strip()
        elif key == "filter_profile":
            out[key] = clean_profile(value)
        else:
            out[key] = value
    return out


def clean_profile(profile: Mapping) -> dict:
    include, exclude = clean_tags(profile.get("locations_include")), clean_tags(profile.get("locations_exclude"))
    low, high = clean_amount(profile.get("compensation_min")), clean_amount(profile.get("compensation_max"))
    currency = profile.get("compensation_currency") if profile.get("compensation_currency") in CURRENCIES else "USD"
    period = profile.get("compensation_period") if profile.get("compensation_period") in PERIODS else "year"
    out = {k: v.strip() for k, v in profile.items() if isinstance(v, str) and k in TAGGED}
    out |= {"locations_include": include, "locations_exclude": exclude, "locations": location_prose(include, exclude)}
    out |= {"compensation_currency": currency, "compensation_period": period, "compensation": pay_prose(low, high, currency, period)}
    out |= {k: v for k, v in (("compensation_min", low), ("compensation_max", high)) if v}
    kept = pruned(profile.get("ai_generated") or {}, out)
    return out | ({"ai_generated": kept} if kept else {})


def generated(before: Mapping, made: Mapping[str, str]) -> dict:
    """Which tags a model wrote, after it wrote some fields anew."""
    out = dict(before or {})
    for key in TAGGED:
        if key in made:
            out.pop(key, None)
            if tags(made[key]):
                out[key] = tags(made[key])
    return out


def pruned(claimed: Mapping, profile: Mapping) -> dict:
    """The model's tags that are still in the profile."""
    out = {}
    for key in TAGGED:
        present = {tag_key(t) for t in tags(profile.get(key))}
        kept = [t for t in claimed.get(key) or [] if tag_key(t) in present]
        if kept:
            out[key] = kept
    return out


def dropped(sent: Mapping, received: Mapping) -> list[str]:
    """What a save lost, by the names that readers know."""
    lost = lambda k: sent.get(k) not in (None, [], ()) and received.get(k) is None
    names = (("location filters", ("locations_include", "locations_exclude")), ("pay range", ("compensation_min", "compensation_max")), ("AI/you tag colours", ("ai_generated",)))
    out = [name for name, keys in names if any(map(lost, keys))]
    if (sent.get("negative_keywords") or "").strip() and not (received.get("negative_keywords") or "").strip():
        out.append("negative keywords")
    return out
