"""Settings from the environment, and what is written down of a run."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Prefixes that name a model's provider, and the model that stands for none.
PROVIDERS = ("gemini/", "vertex_ai/", "google/", "groq/", "openrouter/", "openai/", "anthropic/")
DEFAULT_MODEL = "gemini/gemini-2.5-flash"
EMBEDDER_BACKENDS = ("hash",)


@dataclass(frozen=True)
class Settings:
    """Every field is read from the variable of its name in capitals with QUARRYLINE_ before it."""

    model: str = DEFAULT_MODEL
    embedder: str = "hash"
    collection: str = "medical_kb"
    list_limit: int = 15
    top_k: int = 5
    threshold: float = 0.2
    idle_minutes: int = 30
    tracing: bool = False


def _bool(name: str, text: str) -> bool:
    low = text.casefold()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ValueError(f"{name} must be a boolean value")


def env_file(text: str) -> dict[str, str]:
    """NAME=value lines; quotes around a value, blank lines and comments are left out."""
    pairs = (line.split("=", 1) for line in map(str.strip, text.splitlines()) if line and not line.startswith("#") and "=" in line)
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


def load(env: Mapping[str, str] | None = None, file: str | None = None) -> Settings:
    """From the process's environment, or a file's text where that says nothing; blank values are defaults, bad ones errors."""
    known = {**(env_file(file) if file else {}), **{k: v for k, v in (os.environ if env is None else env).items() if v.strip()}}
    got: dict[str, object] = {}
    for f in fields(Settings):
        name = f"QUARRYLINE_{f.name.upper()}"
        text = known.get(name, "").strip()
        if text:
            kind = type(f.default)
            got[f.name] = _bool(name, text) if kind is bool else kind(text)
    settings = Settings(**got)
    if settings.embedder not in EMBEDDER_BACKENDS:
        raise ValueError(f"no embedder {settings.embedder!r}; there are {list(EMBEDDER_BACKENDS)}")
    return settings


def key_list(text: str | list[str] | None) -> list[str]:
    """Keys of a list or a comma-separated text: trimmed, without empty ones, each once, in order."""
    raw = text.split(",") if isinstance(text, str) else text or []
    return list(dict.fromkeys(k.strip() for k in raw if k.strip()))


def keys_of(c: Column) -> Column:
    """The same of a text column."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda k: F.trim(k)), lambda k: k != ""))


def model_id(c: Column, default: str = DEFAULT_MODEL) -> Column:
    """Model ids in one form: one with a known provider stays, gemini-... gets its provider, a blank one is the default's."""
    name = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(name)
    known = low.startswith(PROVIDERS[0])
    for p in PROVIDERS[1:]:
        known = known | low.startswith(p)
    return F.when(name == "", default).when(known, name).when(low.startswith("gemini-"), F.concat(F.lit("gemini/"), name)).otherwise(name)


@contextmanager
def span(name: str, on: bool, sink: Callable[[dict], None] = print, **attributes: object) -> Iterator[dict]:
    """A named stretch of work; what is put into its state goes to the sink at the end, if tracing is on."""
    state: dict[str, object] = {}
    try:
        yield state
    finally:
        if on:
            sink({"span": name, **{k: v for k, v in {**attributes, **state}.items() if isinstance(v, (str, int, float, bool))}})


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with metrics that are counted as its rows pass by; read them from the observation after an action."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in (metrics or {"rows": F.count(F.lit(1))}).items()]), seen


def status_report(spark: SparkSession, settings: Settings, collections: list[str]) -> DataFrame:
    """One row of what is configured and whether the collection is there; nothing is called."""
    row = (settings.collection in collections, settings.collection, settings.embedder, settings.model, float(settings.threshold))
    return spark.createDataFrame([row], "ready boolean, collection string, embedder string, model string, threshold double")
