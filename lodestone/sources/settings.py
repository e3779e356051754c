"""Settings, prompts and data set listings. Driver side only, but for the listing, which Spark's readers give."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of benchmark files.
DATASET_ENDINGS = ("jsonl", "json", "csv", "tsv")


def env_file(path: str | Path, environ: dict[str, str] | None = None) -> dict[str, str]:
    """Put the NAME=value lines of a file (comments and `export` aside, quotes taken off) into environ where a name is not set yet; return those put."""
    environ, added = os.environ if environ is None else environ, {}
    if not Path(path).exists():
        return added
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        name = name.strip()
        if sep and name and not name.startswith("#") and name not in environ:
            environ[name] = added[name] = value.strip().strip("'\"")
    return added


def configuration(path: str | Path) -> dict:
    """The settings in a file: YAML by its ending, where a YAML reader is installed, else JSON. An empty file has none."""
    content = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix not in (".yaml", ".yml"):
        return json.loads(content or "{}")
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path}: reading YAML needs the yaml package") from e
    return yaml.safe_load(content) or {}


def settings(defaults: Mapping, *paths: str | Path, environ: Mapping[str, str] | None = None, prefix: str = "") -> dict:
    """defaults, overlaid by JSON or YAML files section by section, then by variables PREFIX_SECTION_NAME of the environment (read as JSON where they are)."""
    out = json.loads(json.dumps(defaults))
    for path in paths:
        _overlay(out, configuration(path))
    for section, values in out.items():
        for name in values if isinstance(values, dict) else ():
            value = (os.environ if environ is None else environ).get(f"{prefix}{section}_{name}".upper())
            if value is not None:
                values[name] = _read(value)
    return out


def _overlay(base: dict, over: Mapping) -> None:
    for key, value in over.items():
        if isinstance(value, Mapping) and isinstance(base.get(key), dict):
            _overlay(base[key], value)
        else:
            base[key] = value


def _read(value: str) -> object:
    try:
        return json.loads(value)
    except ValueError:
        return value


TAXONOMY = ("acronyms", "task_synonyms", "method_synonyms", "domain_keywords")


def taxonomy(spark: SparkSession, path: str | Path) -> DataFrame:
    """section, term, place, synonym of a taxonomy file (sections of TAXONOMY: term to list); no rows without a file, so nothing is expanded."""
    held = configuration(path) if Path(path).exists() else {}
    rows = [(section, str(term), n, str(value)) for section in TAXONOMY for term, values in (held.get(section) or {}).items() for n, value in enumerate(values or ())]
    return spark.createDataFrame(rows, "section string, term string, place int, synonym string")


@dataclass(frozen=True)
class Prompt:
    """A template with $fields, those that must be given, and the keys that an answer must have. render may be another function."""

    name: str
    template: str
    required: tuple[str, ...] = ()
    answer_keys: tuple[str, ...] = ()
    renderer: Callable[[str, Mapping[str, str]], str] | None = None

    def render(self, **values: str) -> str:
        if missing := [f for f in self.required if f not in values]:
            raise ValueError(f"prompt {self.name} lacks {', '.join(missing)}")
        return self.renderer(self.template, values) if self.renderer else string.Template(self.template).safe_substitute(values)

    def accepts(self, answer: Mapping) -> bool:
        return all(k in answer for k in self.answer_keys)


@dataclass
class Prompts:
    """Prompts by name; a name is given once, unless it is replaced on purpose."""

    known: dict[str, Prompt] = field(default_factory=dict)

    def add(self, prompt: Prompt, replace: bool = False) -> Prompt:
        if prompt.name in self.known and not replace:
            raise ValueError(f"prompt {prompt.name} is known already")
        self.known[prompt.name] = prompt
        return prompt

    def get(self, name: str) -> Prompt:
        return self.known[name]


def datasets(spark: SparkSession, folder: str, endings: tuple[str, ...] = DATASET_ENDINGS) -> DataFrame:
    """name, path, bytes of the benchmark files in a folder and below it, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(endings)}}}").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", F.col("length").alias("bytes")).orderBy("name", "path")
