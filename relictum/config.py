"""A project's declaration, checked field by field."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from relictum.operators.acquisition import Budgets
from relictum.operators.captures import DEFAULT_FILTERS, EARLIEST_LARGEST, NEAREST, CandidateFilter
from relictum.operators.fidelity import ACCEPT, ACCEPT_WITH_WARNING, Tuning

MATCH_TYPES = ("exact", "prefix", "host", "domain")
FOLLOWED = ("stylesheet", "script", "image", "media", "frame", "object", "document")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Project:
    project_id: str
    url: str
    match_type: str = "domain"
    start: str | None = None
    end: str | None = None
    seed_urls: tuple[str, ...] = ()
    dependency_hosts: tuple[str, ...] = ()
    budgets: Budgets = Budgets()
    allowed_hosts: tuple[str, ...] = ()
    min_interval_ms: int = 1500
    follow_relations: tuple[str, ...] = FOLLOWED
    follow_page_links: bool = False
    policy: str = NEAREST
    cluster_days: int = 90
    window_days: int = 365
    max_lookup_pages: int = 10
    reselection_attempts: int = 2
    candidate_filters: tuple[str, ...] = DEFAULT_FILTERS
    tuning: Tuning = field(default_factory=Tuning)
    accept: float = ACCEPT
    accept_with_warning: float = ACCEPT_WITH_WARNING
    overrides: tuple[tuple[str, str, str], ...] = ()


def parse_project(text: str, source: str = "project") -> Project:
    """A project from JSON; what is missing gets its default, what is wrong is named."""
    try:
        d = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(f"{source} is not JSON: {e}") from e

    def fail(name: str, why: str):
        raise ConfigError(f"{source}: {name} {why}")

    def get(path: str, kind, default=None, check=None):
        value, at = d, path.split(".")
        for part in at:
            value = value.get(part) if isinstance(value, dict) else None
        if value is None:
            if default is None and kind is not type(None):
                return default
            return default
        if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
            fail(path, "has the wrong type")
        if check and not check(value):
            fail(path, "is out of range")
        return tuple(value) if isinstance(value, list) else value

    positive = lambda v: v > 0
    stamp = lambda v: v == "" or re.fullmatch(r"\d{4,14}", v) is not None
    name = get("projectId", str, check=lambda v: re.fullmatch(r"[a-z0-9][a-z0-9-]{0,63}", v)) or fail("projectId", "is missing")
    url = get("scope.url", str) or fail("scope.url", "is missing")
    spent = {f.name: get("budgets." + re.sub(r"_(\w)", lambda m: m[1].upper(), f.name).replace("maxAttempts", "maxAttemptsPerItem"), int, f.default, positive) for f in fields(Budgets)}
    filters = get("candidateFilters", list, DEFAULT_FILTERS)
    for f in filters:
        CandidateFilter.parse(f)
    accept, warn = (get(f"fidelity.thresholds.{n}", (int, float), v) for n, v in (("accept", ACCEPT), ("acceptWithWarning", ACCEPT_WITH_WARNING)))
    if warn > accept:
        fail("fidelity.thresholds", "are out of order")
    return Project(
        name, url, get("scope.matchType", str, "domain", lambda v: v in MATCH_TYPES), get("scope.from", str, None, stamp), get("scope.to", str, None, stamp),
        get("scope.seedUrls", list, ()), get("scope.dependencyHosts", list, ()), Budgets(**spent), get("provider.allowedHosts", list, ()),
        get("provider.minRequestIntervalMs", int, 1500), get("discovery.followRelations", list, FOLLOWED), get("discovery.followPageLinks", bool, False),
        get("selection.policy", str, NEAREST, lambda v: v in (NEAREST, EARLIEST_LARGEST)), get("selection.clusterWindowDays", int, 90, positive),
        get("assetResolution.windowDays", int, 365, positive), get("assetResolution.maxLookupPages", int, 10, positive), get("outcomeReselection.maxAttempts", int, 2, lambda v: v >= 0),
        tuple(filters), Tuning(), accept, warn, tuple((o["originalUrl"], o["reason"], o["recordedBy"]) for o in get("fidelity.overrides", list, ())),
    )
