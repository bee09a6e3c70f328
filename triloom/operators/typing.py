"""Constellation typing: which samples carry enough of a type's signature mutations."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.operators import state
from triloom.schema import PRESENT, UNKNOWN


@dataclass(frozen=True)
class Definition:
    label: str
    sites: tuple[str, ...]
    must_have: tuple[str, ...] = ()
    min_alt: int | None = None
    max_ref: int = 0

    @property
    def needed(self) -> int:
        return len(self.sites) if self.min_alt is None else self.min_alt


_TEXT = re.compile(r"\S")


def documents(text: str) -> list[dict]:
    """The JSON documents that a text holds, one after the other."""
    read, out, at = json.JSONDecoder().raw_decode, [], 0
    while (start := _TEXT.search(text, at)) is not None:
        d, at = read(text, start.start())
        out.append(d)
    return out


def definitions(texts: list[str], to_id) -> dict[str, Definition]:
    """Definitions by label and tag from constellation JSON texts of one or several; the first of a label wins,
    one with a site that to_id cannot read (None) is skipped."""
    out: dict[str, Definition] = {}
    for d in (d for text in texts for d in documents(text)):
        rules = dict(d["rules"])
        low, high = rules.pop("min_alt", None), rules.pop("max_ref", 0)
        sites, must = [to_id(s) for s in d["sites"]], [to_id(s) for s, how in rules.items() if how == "alt"]
        if None in sites or None in must:
            continue
        for label in [*d["tags"], d["label"]]:
            out.setdefault(label, Definition(label, tuple(dict.fromkeys(sites)), tuple(must), low, high))
    return out


@dataclass(frozen=True)
class Sites:
    """Statuses at n sites: rows (site, sample_id, status), none where a sample says nothing of a site."""

    n: int
    rows: DataFrame

    def __len__(self) -> int:
        return self.n


def sites_of(statuses: list[DataFrame]) -> Sites:
    """From a table (sample_id, status) for each site: a scan a site, for features that have no common one."""
    rows = None
    for i, t in enumerate(statuses):
        part = t.select(F.lit(i).alias("site"), "sample_id", "status")
        rows = part if rows is None else rows.union(part)
    return Sites(len(statuses), rows)


def site_counts(base: DataFrame, sites: Sites) -> DataFrame:
    """(sample_id, status, present, unknown): per sample of base, at how many sites it is found or unknown."""
    n = sites.rows.groupBy("sample_id").agg(F.sum((F.col("status") == PRESENT).cast("long")).alias("present"), F.sum((F.col("status") == UNKNOWN).cast("long")).alias("unknown"))
    return base.join(n, "sample_id", "left").fillna(0, ["present", "unknown"])


def imperfect(base: DataFrame, sites: Sites, min_alt: int, max_ref: int, strict: bool = True) -> DataFrame:
    """Samples of base with at least min_alt sites and at most max_ref reference sites. strict=False
    counts one more for each sample that base itself has, as the original does."""
    c = site_counts(base, sites)
    # A site's status in the query is the lesser of both.
    found = F.when(F.col("status") == PRESENT, F.col("present")).otherwise(0)
    unsure = F.when(F.col("status") == PRESENT, F.col("unknown")).when(F.col("status") == UNKNOWN, F.col("present") + F.col("unknown")).otherwise(0)
    if not strict:
        found, unsure = found + (F.col("status") == PRESENT).cast("int"), unsure + (F.col("status") == UNKNOWN).cast("int")
    ok = (found >= min_alt) & (F.lit(sites.n) - found - unsure <= max_ref)
    return state.restrict_where(c, ok)


def perfect(base: DataFrame, sites: Sites) -> DataFrame:
    """The conjunction over all sites, in one aggregation."""
    c = site_counts(base, sites)
    n = sites.n
    all_sites = F.when(F.col("present") == n, PRESENT).when(F.col("present") + F.col("unknown") == n, UNKNOWN).otherwise(0)
    return c.select("sample_id", F.least("status", all_sites).alias("status"))


def isa_type(base: DataFrame, sites: Sites, must_have: Sites | None, min_alt: int, max_ref: int, strict: bool = True, perfect_only: bool = False) -> DataFrame:
    """base and (perfect or imperfect matches); unknown samples of base stay unknown where they match."""
    if must_have is not None and must_have.n:
        base = perfect(base, must_have)
    if perfect_only or min_alt == sites.n:
        return perfect(base, sites)
    known = state.reset_universe(state.select(base, PRESENT), include_unknown=False)
    full = perfect(known, sites)
    rest = state.or_(state.select(full, UNKNOWN), state.select(full, 0))
    some = imperfect(rest, sites, min_alt, max_ref, strict)
    return state.and_(base, state.or_(state.select(full, PRESENT), state.select(some, PRESENT)))
