"""Settings of the standalone publisher, read from a properties file and overridden by a mapping."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from rowtide.functions.codecs import load
from rowtide.sources.catalog import Selection

PREFIX = "rowtide."
DEFAULT_FILE = "rowtide.properties"


def duration(text: str) -> float:
    """Seconds of an ISO 8601 duration of days to seconds, such as PT0.1S."""
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text.strip(), re.I)
    if not m or not any(m.groups()):
        raise ValueError(f"no ISO 8601 duration: {text}")
    d, h, mi, s = (float(x or 0) for x in m.groups())
    return ((d * 24 + h) * 60 + mi) * 60 + s


def flag(text: str) -> bool:
    return text.strip().lower() == "true"


def read_properties(path: str | None = None) -> dict[str, str]:
    """A named file must exist; the default one in the working folder may be missing."""
    if path is None:
        if not os.path.exists(DEFAULT_FILE):
            return {}
        path = DEFAULT_FILE
    with open(path) as f:
        lines = [x.strip() for x in f]
    pairs = (re.split(r"\s*[=:]\s*", x, maxsplit=1) for x in lines if x and x[0] not in "#!")
    return {p[0]: p[1] if len(p) > 1 else "" for p in pairs}


@dataclass(frozen=True)
class Config:
    source_path: str
    database: str
    selection: Selection
    topic_format: str
    topics_path: str
    create_topics: bool
    poll_interval: float
    converter: str
    max_wait_s: int
    demo: bool
    project: str
    instance: str

    @classmethod
    def read(cls, properties: dict[str, str], overrides: dict[str, str] | None = None) -> Config:
        p = properties | (overrides or {})
        get = lambda k, default=None: p.get(PREFIX + k, default)

        def need(k: str) -> str:
            if not get(k):
                raise ValueError(f"{PREFIX}{k} is required")
            return get(k)

        names = lambda k: tuple(x for x in (get(k) or "").split(",") if x)
        included, excluded = names("source.includedTables"), names("source.excludedTables")
        said = get("source.allTables")
        every = flag(said) if said is not None else not included
        if included and excluded:
            raise ValueError("both included and excluded tables are given")
        if every and included:
            raise ValueError("all tables are asked for, and some are included")
        if not every and excluded:
            raise ValueError("tables are excluded, but not all tables are asked for")
        if not every and not included:
            raise ValueError("no tables are asked for")
        converter = get("topics.converter", "avro")
        load(converter)
        return cls(
            source_path=need("source.path"),
            database=need("source.database"),
            selection=Selection.all_tables().but(*excluded) if every else Selection.include(*included),
            topic_format=need("topics.nameFormat"),
            topics_path=get("topics.path", "topics"),
            create_topics=flag(get("topics.create", "false")),
            poll_interval=duration(get("source.pollInterval", "PT0.1S")),
            converter=converter,
            max_wait_s=int(get("maxWaitForShutdownSeconds", "10")),
            demo=flag(get("demoMode", "false")),
            project=get("source.project", ""),
            instance=get("source.instance", ""),
        )
