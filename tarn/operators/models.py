"""The places where a model is asked. Models are callables; offline stand-ins follow fixed rules and do not
judge as a model would. Whatever comes back is validated by expressions."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.dates import posted_date
from tarn.functions.money import looks_like_pay
from tarn.functions.text import blank_to_null, strip
from tarn.operators.gates import VERDICT

Model = Callable[[str, str], str]
BATCH = 20
_RAW = "struct<postings: array<struct<title: string, link_id: string, url: string, company: string, location: string, posted_at: string, posted_text: string, compensation: string>>>"


def without_fences(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def with_retries(call: Model, attempts: int = 4, base: float = 1.5, wait: Callable[[float], None] = time.sleep) -> Model:
    """call, asked again with doubling pauses while it reports that it is busy or failing."""

    def asked(system: str, user: str) -> str:
        for k in range(attempts):
            try:
                return call(system, user)
            except RuntimeError as error:
                if k + 1 == attempts or not re.search(r"\b(429|5\d\d)\b", str(error)):
                    raise
                wait(base * 2**k)
        raise AssertionError

    return asked


def request_ladder(schema: dict, name: str) -> list[dict]:
    """The settings to ask for JSON with, from the strictest to none; the next is used where one is refused."""
    strict = {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": schema}}
    return [{"response_format": strict, "temperature": 0}, {"response_format": {"type": "json_object"}, "temperature": 0}, {"temperature": 0}, {}]


def asked(rows: DataFrame, prompt: str, system: str, model: Model) -> DataFrame:
    """rows with answer: the model's reply to the prompt column, row by row within Arrow batches. The model
    is not deterministic, so the reply must be written before it is read twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=[model(system, p) for p in batch[prompt]])

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1] + ",answer:string")


def postings(raw: Column) -> Column:
    """array of validated postings from a model's JSON; what has no title is left out."""
    text = lambda v, most: F.when(F.length(strip(v)) <= most, blank_to_null(v))

    def one(p: Column) -> Column:
        pay = text(p["compensation"], 100)
        return F.struct(
            F.substring(strip(p["title"]), 1, 300).alias("title"), F.when(p["link_id"].rlike(r"^\d+$"), p["link_id"].try_cast("int")).alias("link_id"),
            blank_to_null(p["url"]).alias("url"), blank_to_null(p["company"]).alias("company"), text(p["location"], 200).alias("location"),
            posted_date(p["posted_at"]).alias("posted_at"), blank_to_null(p["posted_text"]).alias("posted_text"), F.when(looks_like_pay(pay), pay).alias("compensation"),
        )

    found = F.from_json(without_fences(raw), _RAW)["postings"]
    return F.transform(F.filter(found, lambda p: blank_to_null(p["title"]).isNotNull()), one)


def verdicts(raw: Column, count: Column) -> Column:
    """map<id, verdict> from a model's JSON: known kinds and ids only, the first of an id; a title mismatch decides."""
    found = F.from_json(without_fences(raw), "struct<verdicts: array<struct<id: string, verdict: string, summary: string, title_mismatch: string>>>")["verdicts"]
    ok = F.filter(found, lambda v: v["id"].rlike(r"^\d+$") & (v["id"].try_cast("int") < count) & v["verdict"].isin("match", "mismatch", "borderline"))

    def entry(v: Column) -> Column:
        said = blank_to_null(v["title_mismatch"])
        said = F.when(~said.rlike("(?i)^(null|none|n/a)$"), said)
        kind = F.when(said.isNotNull(), "mismatch").otherwise(v["verdict"])
        return F.struct(v["id"].cast("int").alias("key"), F.struct(kind.alias("verdict"), F.coalesce(strip(v["summary"]), F.lit("")).alias("summary"), said.alias("title_mismatch")).cast(VERDICT).alias("value"))

    first = F.filter(F.transform(ok, entry), lambda e: F.lit(True))
    none = F.array().cast(f"array<struct<key: int, value: {VERDICT}>>")
    once = F.aggregate(first, none, lambda acc, e: F.when(F.exists(acc, lambda x: x["key"] == e["key"]), acc).otherwise(F.array_append(acc, e)))
    return F.map_from_entries(once)


def keyword_judge(title: Column, wanted: Column) -> Column:
    """An offline stand-in for the judge: match if the title holds any wanted word, else borderline."""
    low = F.lower(title)
    hit = F.exists(wanted, lambda w: low.contains(w))
    kind = F.when(hit, "match").otherwise("borderline")
    return F.struct(kind.alias("verdict"), F.concat(F.lit("Judged offline by its title: "), kind).alias("summary"), F.lit(None).cast("string").alias("title_mismatch")).cast(VERDICT)


def expanded_profile(answer: str) -> dict[str, str]:
    """The three text fields of a model's profile, trimmed; anything else is an error."""
    got = json.loads(answer)
    if not isinstance(got, dict):
        raise ValueError("a profile must be an object")
    return {k: v.strip() for k in ("roles", "role_synonyms", "title_keywords") if isinstance(v := got.get(k, ""), str)}
