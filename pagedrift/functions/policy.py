"""Validation columns for targets, urls, selectors, records, states and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import patterns as P
from ..schemas import FIELDS
from .text import trim_blanks


def url_host(url: Column) -> Column:
    """Lower-case host of an https url, '' for anything else."""
    return F.lower(F.regexp_extract(url, P.java_regex(P.HTTPS_HOST), 1))


def host_public(host: Column) -> Column:
    """Not empty, and not an internal or private host."""
    blocked = (
        host.isin(*P.BLOCKED_HOSTS)
        | host.rlike(P.BLOCKED_HOST_PREFIX)
        | host.contains(P.BLOCKED_HOST_PART)
    )
    for suffix in P.BLOCKED_HOST_SUFFIXES:
        blocked = blocked | host.endswith(suffix)
    return (host != "") & ~blocked


def host_domains(host: Column) -> Column:
    """The host and every domain it lies below: ``a.b.c``, ``b.c``, ``c``."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def url_allowed(url: Column, allowed_domains: Sequence[str]) -> Column:
    """https, not an internal or private host, and on (or below) an allowed domain."""
    host = url_host(url)
    allowed = F.lit(False)
    for domain in allowed_domains:
        allowed = allowed | (host == domain) | host.endswith("." + domain)
    return F.coalesce(host_public(host) & allowed, F.lit(False))


def selector_allowed(selector: Column) -> Column:
    return F.coalesce(
        selector.rlike(P.java_regex(P.SELECTOR_SAFE))
        & (F.length(selector) <= P.SELECTOR_LIMIT)
        & ~selector.rlike(P.SELECTOR_UNSAFE),
        F.lit(False),
    )


def _blank(col: Column) -> Column:
    return F.coalesce(trim_blanks(col), F.lit("")) == ""


def target_problem(allowed_domains: Sequence[str]) -> Column:
    """Why a target row is invalid, or null when it is valid."""
    url, selector, name, notes = (F.col(c) for c in ("url", "selector", "name", "notes"))
    return (
        F.when(_blank(url), "url missing")
        .when(_blank(selector), "selector missing")
        .when(~url_allowed(url, allowed_domains), "url not allowed")
        .when(~selector_allowed(selector), "selector not allowed")
        .when(name.isNotNull() & ~F.length(name).between(1, P.NAME_LIMIT), "name length")
        .when(name.isNotNull() & name.rlike(P.NAME_UNSAFE), "name unsafe")
        .when(notes.isNotNull() & (F.length(notes) > P.NOTES_LIMIT), "notes length")
        .when(notes.isNotNull() & notes.rlike(P.NOTES_UNSAFE), "notes unsafe")
    )


def promo_valid(promo: Column) -> Column:
    out = promo.isNotNull() & promo["id"].isNotNull() & ~_blank(promo["id"])
    for field in FIELDS:
        out = out & promo[field].isNotNull()
    return F.coalesce(out, F.lit(False))


def snapshot_valid(hash_col: Column, time_text: Column, promos: Column) -> Column:
    """Hash and time present, the time readable, every record valid."""
    return F.coalesce(
        ~_blank(hash_col)
        & ~_blank(time_text)
        & F.try_to_timestamp(time_text).isNotNull()
        & promos.isNotNull()
        & F.forall(promos, promo_valid),
        F.lit(False),
    )
