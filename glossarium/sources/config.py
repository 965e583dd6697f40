"""Configuration files (YAML) of a project: profiles, parser presets, source filters, symbols. All of it is read by the
driver and compiled to columns; of data only the distinct paths of sources are looked at."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.profiles import Profile
from ..operators.filters import SourceFilter
from ..operators.parsing import Preset

# The fields of a preset, by the groups of its pattern that they are; the keys of a source filter, by the
# parts of a rule that they give.
PRESET_FIELDS = {"syllables": "syllables", "headword_raw": "headword", "pos_raw": "pos", "origin_raw": "origin", "pron_raw": "pron"}
FILTER_KEYS = {
    "drop_before_regex": "drop_before", "drop_after_regex": "drop_after", "exclude_line_ranges": "line_ranges", "drop_line_regexes": "drop_lines",
    "case_insensitive": "ignore_case",
}


class ConfigError(ValueError):
    """A configuration with all that is wrong with it."""

    def __init__(self, errors: Iterable[str]):
        self.errors = list(errors)
        super().__init__("; ".join(self.errors))


def read_yaml(path: str | Path) -> dict:
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError([f"can't read {path}: {e}"]) from e
    except yaml.YAMLError as e:
        raise ConfigError([f"no YAML in {path}: {e}"]) from e
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ConfigError([f"{path} holds no mapping"])
    return data


class _Section:
    """A mapping that is read key by key; it knows what was wrong and which keys no one asked for."""

    def __init__(self, data: object, name: str, errors: list[str]):
        self.errors, self.name, self.asked = errors, name, set()
        if data is not None and not isinstance(data, dict):
            errors.append(f"{name} must be a mapping")
        self.data = data if isinstance(data, dict) else {}

    def get(self, key: str, kind: type | tuple[type, ...], default):
        self.asked.add(key)
        value = self.data.get(key, default)
        if value is None:
            return default
        if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
            self.errors.append(f"{self.name}.{key} is of the wrong kind")
            return default
        return value

    def pattern(self, key: str):
        value = self.get(key, str, None)
        if value is not None:
            _compiles(value, f"{self.name}.{key}", self.errors)
        return value

    def unknown(self) -> list[str]:
        return [f"unknown key {self.name}.{k}" for k in self.data if k not in self.asked]


def _compiles(pattern: str, where: str, errors: list[str]) -> None:
    try:
        re.compile(pattern)
    except re.error as e:
        errors.append(f"{where}: {e}")


def profile_of(data: dict, strict: bool = False) -> tuple[Profile, list[str]]:
    """A profile and warnings (keys that nothing reads; errors if ``strict``)."""
    errors: list[str] = []
    part = lambda key, other=None: _Section(data.get(key, data.get(other) if other else None), key, errors)
    top, display, norm, render, qa = _Section(data, "profile", errors), part("display"), part("norm", "alignment"), part("render", "output"), part("qa")
    unicode = _Section(data["unicode"], "unicode", errors).get("normalization", str, "NFC") if isinstance(data.get("unicode"), dict) else data.get("unicode") or "NFC"
    if unicode not in ("NFC", "NFD", "NFKC", "NFKD"):
        errors.append("unicode.normalization must be NFC, NFD, NFKC or NFKD")
        unicode = "NFC"
    id_, version = top.get("profile_id", str, ""), data.get("version")
    if not id_.strip():
        errors.append("profile_id is required")
    if isinstance(version, str) and version.strip().isdigit():
        version = int(version)
    if not isinstance(version, int):
        errors.append("version must be a whole number")
    features = part("features")
    marks = _Section(features.get("marks", dict, {}), "features.marks", errors)
    rules = []
    for i, r in enumerate(features.get("rules", list, [])):
        rule = _Section(r, f"features.rules[{i}]", errors)
        when = _Section(rule.get("when", dict, {}), f"features.rules[{i}].when", errors)
        conditions = {"contains": when.get("contains", str, None), "contains_any": when.get("contains_any", (str, list), None), "pattern": when.pattern("pattern")}
        if not isinstance(rule.data.get("set"), dict):
            errors.append(f"features.rules[{i}].set must be a mapping")
        else:
            rules.append(({k: v for k, v in conditions.items() if v is not None}, rule.get("set", dict, {})))
    quantity = {marks.get(k, str, ""): v for k, v in (("macron", "long"), ("breve", "short"))}
    extra = [str(x) for s in (display, norm) for x in s.get("allowed_extra_symbols", list, [])]
    out = dict(
        profile_id=id_, version=version, unicode=unicode,
        display_keep_long_s=display.get("keep_long_s", bool, True), display_lower=display.get("lowercase", bool, False),
        norm_lower=norm.get("lowercase", bool, True), strip_diacritics=norm.get("strip_diacritics", bool, False),
        remove_punctuation=norm.get("remove_punctuation", bool, False), keep_hyphen=norm.get("keep_hyphen", bool, not norm.get("remove_hyphens", bool, False)),
        char_map={str(k): str(v) for k, v in {**display.get("char_map", dict, {}), **norm.get("char_map", dict, {})}.items()},
        render_enabled=render.get("enabled", bool, True), render_source=render.get("source", str, "norm"),
        paren_primes=render.get("parenthesize_prime_segment", bool, False), paren_accents=render.get("parenthesize_accented_vowel", bool, False),
        open_paren=render.get("open_paren", str, "("), close_paren=render.get("close_paren", str, ")"),
        prime=marks.get("prime", str, "ʹ"), acute_vowels=marks.get("acute_vowels", str, ""),
        quantity_marks={k: v for k, v in quantity.items() if k}, rules=tuple(rules), allowed_symbols="".join(extra),
        enforce_stress_consistency=qa.get("enforce_stress_consistency", bool, False), require_prime=qa.get("require_prime_for_primary_stress", bool, False) and "prime" in marks.data,
        require_acute=qa.get("require_acute_for_primary_stress", bool, False) and "acute_vowels" in marks.data, require_pronunciation=qa.get("require_pronunciation", bool, False),
    )
    for section, known in ((display, ("normalize_primes", "collapse_spaces")), (norm, ("normalize_primes", "long_s_to_s", "collapse_spaces")), (render, ("collapse_spaces",))):
        section.asked.update(known)
    top.asked.update(("version", "unicode", "display", "norm", "alignment", "render", "output", "features", "qa", "name", "description", "dict_id"))
    warnings = [w for s in (top, display, norm, render, features, marks, qa) for w in s.unknown()]
    if errors or strict and warnings:
        raise ConfigError(errors + (warnings if strict else []))
    return Profile(**out), warnings


def load_profile(path: str | Path, strict: bool = False) -> Profile:
    return profile_of(read_yaml(path), strict)[0]


def profile_yaml(p: Profile) -> str:
    """A profile as the YAML that profile_of reads."""
    import yaml

    marks = {"prime": p.prime, "acute_vowels": p.acute_vowels} | {{"long": "macron", "short": "breve"}[v]: k for k, v in p.quantity_marks.items()}
    data = {
        "profile_id": p.profile_id, "version": p.version, "unicode": {"normalization": p.unicode},
        "display": {"keep_long_s": p.display_keep_long_s, "lowercase": p.display_lower, "allowed_extra_symbols": list(p.allowed_symbols)},
        "norm": {"lowercase": p.norm_lower, "strip_diacritics": p.strip_diacritics, "remove_punctuation": p.remove_punctuation, "keep_hyphen": p.keep_hyphen, "char_map": dict(p.char_map)},
        "render": {"enabled": p.render_enabled, "source": p.render_source, "parenthesize_prime_segment": p.paren_primes, "parenthesize_accented_vowel": p.paren_accents, "open_paren": p.open_paren, "close_paren": p.close_paren},
        "features": {"marks": {k: v for k, v in marks.items() if v}, "rules": [{"when": dict(w), "set": dict(s)} for w, s in p.rules]},
        "qa": {"enforce_stress_consistency": p.enforce_stress_consistency, "require_prime_for_primary_stress": p.require_prime, "require_acute_for_primary_stress": p.require_acute, "require_pronunciation": p.require_pronunciation},
    }
    return yaml.safe_dump(data, sort_keys=False, allow_unicode=True)


def override_profile(base: Profile, settings: dict) -> Profile:
    """A profile with the choices of a form laid over it; choices of the wrong kind are ignored."""
    flag = lambda key, old: settings[key] if isinstance(settings.get(key), bool) else old
    stress = str(settings.get("stress_mode", "both")).strip().lower()
    shown = {
        "none": {"render_enabled": False, "paren_accents": False, "paren_primes": False},
        "accent": {"render_enabled": True, "render_source": "norm", "paren_accents": True, "paren_primes": False},
        "prime": {"render_enabled": True, "render_source": "display", "paren_accents": False, "paren_primes": True},
    }.get(str(settings.get("render_mode", "none")).strip().lower(), {})
    version = settings.get("version")
    return replace(
        base, profile_id=str(settings.get("profile_id") or base.profile_id).strip(), version=version if isinstance(version, int) else base.version,
        norm_lower=flag("lowercase", base.norm_lower), strip_diacritics=flag("strip_diacritics", base.strip_diacritics), remove_punctuation=flag("remove_punctuation", base.remove_punctuation),
        require_pronunciation=flag("require_pronunciation", base.require_pronunciation), enforce_stress_consistency=flag("enforce_stress_consistency", base.enforce_stress_consistency),
        require_prime=stress != "acute", require_acute=stress != "prime", **shown,
    )


def preset_of(data: dict) -> Preset:
    """A parser preset; every field names a group of its pattern."""
    errors: list[str] = []
    top = _Section(data, "preset", errors)
    id_, pattern = top.get("parser_id", str, ""), top.pattern("entry_regex")
    if not id_.strip() or not pattern or not isinstance(data.get("version"), int):
        errors.append("parser_id, version and entry_regex are required")
    fields = {k: v for k, v in top.get("fields", dict, {}).items() if k in PRESET_FIELDS}
    errors += [f"fields.{k} must be a group's number" for k, v in fields.items() if not isinstance(v, int) or v < 1]
    errors += [f"fields.{k} is required" for k in ("syllables", "headword_raw", "pos_raw") if k not in fields]
    maps = {k: top.get(k, dict, {}) for k in ("pos_map", "origin_map")}
    errors += [f"{k} must map text to text" for k, m in maps.items() if not all(isinstance(x, str) for kv in m.items() for x in kv)]
    extra = top.get("allow_extra_trailing", bool, False)
    if not errors and max(fields.values()) > re.compile(pattern).groups:
        errors.append("a field names a group that the pattern lacks")
    if errors:
        raise ConfigError(errors)
    return Preset(id_.strip(), pattern, {PRESET_FIELDS[k]: v for k, v in fields.items()}, maps["pos_map"], maps["origin_map"], data["version"], extra)


def load_preset(path: str | Path) -> Preset:
    return preset_of(read_yaml(path))


def discover_presets(rules: str | Path, dict_id: str | None = None) -> dict[str, Preset]:
    """Readable presets by path: a corpus' own folder, the folder of parsers, the rules folder."""
    folders = [Path(rules) / dict_id] if dict_id else []
    out = {}
    for folder in [*folders, Path(rules) / "parsers", Path(rules)]:
        for path in sorted(p for p in folder.glob("*") if p.suffix in (".yml", ".yaml")):
            try:
                out.setdefault(str(path), load_preset(path))
            except ConfigError:
                continue
    return out


def resolve_preset(rules: str | Path, dict_id: str, name: str | None = None) -> Preset | None:
    """The preset of a name, id or path; without a name the corpus' own: parser.yml, parser_v1.yml, else its first."""
    if name and name.lower() != "auto":
        if Path(name).exists():
            return load_preset(name)
        for path, preset in discover_presets(rules, dict_id).items():
            if name in (preset.parser_id, Path(path).stem):
                return preset
        raise FileNotFoundError(f"no preset {name}")
    own = {Path(p).name: v for p, v in discover_presets(rules, dict_id).items() if Path(p).parent == Path(rules) / dict_id}
    order = ("parser.yml", "parser.yaml", "parser_v1.yml", "parser_v1.yaml")
    return next((own[n] for n in [*order, *sorted(own)] if n in own), None)


def line_range(value: object) -> tuple[int, int]:
    """N or N-M, from 1."""
    m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", str(value)) if not isinstance(value, bool) else None
    first, last = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
    if not 1 <= first <= last:
        raise ConfigError([f"{value!r} is no line range N or N-M"])
    return first, last


@dataclass(frozen=True)
class FilterConfig:
    """The rule of all sources, and what sources of a pattern have in place of its parts."""

    enabled: bool
    default: dict
    sources: tuple[tuple[str, dict], ...]
    root: str = ""

    def choice(self, source_path: str | None) -> tuple[list[str], dict[str, int]]:
        """The patterns that fit a source, and for each key the place of the one it comes from: the last that fits and has
        it, counted from 1; 0 is what all sources have."""
        fits, places = [], dict.fromkeys(FILTER_KEYS, 0)
        names = [n.casefold() for n in _names(source_path or "", self.root)]
        for place, (pattern, keys) in enumerate(self.sources, 1):
            if any(fnmatch.fnmatchcase(n, pattern.replace("\\", "/").strip().casefold()) for n in names):
                fits.append(pattern)
                places |= dict.fromkeys(keys, place)
        return fits, places

    def candidates(self, part: str) -> list:
        """What a part of the rule is for all sources, then with each pattern's keys; nothing where filters are off."""
        key = {v: k for k, v in FILTER_KEYS.items()}[part]
        values = [keys.get(key) for keys in (self.default, *(keys for _, keys in self.sources))]
        if part == "ignore_case":
            return [True if v is None else v for v in values]
        if not self.enabled:
            return [()] * len(values)
        return [() if not v else (v,) if isinstance(v, str) else tuple(v) for v in values]

    def rule(self, source_path: str) -> tuple[SourceFilter, list[str]]:
        """A source's rule and the patterns that fit it; later ones replace the keys of earlier ones."""
        fits, places = self.choice(source_path)
        return SourceFilter(**{part: self.candidates(part)[places[key]] for key, part in FILTER_KEYS.items()}), fits

    def tagged(self, sources: DataFrame) -> DataFrame:
        """Sources with the places of their rule's parts: paths are few beside lines, so each is looked at once, in batches."""
        parts = list(FILTER_KEYS.items())

        def tag(frames):
            for f in frames:
                chosen = [self.choice(p) for p in f["_source"]]
                out = {"_source": f["_source"], "rule_patterns": [fits for fits, _ in chosen]}
                yield pd.DataFrame(out | {f"_{part}": [places[key] for _, places in chosen] for key, part in parts})

        return sources.mapInPandas(tag, ", ".join(["_source string, rule_patterns array<string>", *(f"_{part} int" for _, part in parts)]))


def _names(path: str, root: str) -> list[str]:
    """What a pattern may fit: the path, its last part, and what it is within the project and its imports."""
    path = path.removeprefix("file:").replace("\\", "/")
    inside = [path[len(r) + 1 :] for r in (root.rstrip("/"), root.rstrip("/") + "/data/raw/imports") if root and path.startswith(r + "/")]
    return [path, path.rsplit("/", 1)[-1], *inside]


def filters_of(data: dict, root: str = "") -> FilterConfig:
    errors: list[str] = []

    def rule(data: object, name: str) -> dict:
        s = _Section(data, name, errors)
        out: dict = {"drop_before_regex": s.pattern("drop_before_regex"), "drop_after_regex": s.pattern("drop_after_regex"), "case_insensitive": s.get("case_insensitive", bool, True)}
        out["drop_line_regexes"] = [str(x) for x in s.get("drop_line_regexes", list, [])]
        for x in out["drop_line_regexes"]:
            _compiles(x, f"{name}.drop_line_regexes", errors)
        ranges = []
        for x in s.get("exclude_line_ranges", list, []):
            try:
                ranges.append(line_range(x))
            except ConfigError as e:
                errors.extend(e.errors)
        out["exclude_line_ranges"] = ranges
        errors.extend(s.unknown())
        return {k: v for k, v in out.items() if k in s.data}

    top = _Section(data, "filters", errors)
    enabled = top.get("enabled", bool, True)
    sources = tuple((str(k).strip(), rule(v, f"sources.{k}")) for k, v in top.get("sources", dict, {}).items())
    errors += ["sources must be named"] if any(not k for k, _ in sources) else []
    out = FilterConfig(enabled, rule(top.get("default", dict, {}), "default"), sources, root)
    errors += top.unknown()
    if errors:
        raise ConfigError(errors)
    return out


def find_filters(rules: str | Path, dict_id: str | None = None) -> Path | None:
    """A corpus' source filters, else the shared ones."""
    folders = [*([Path(rules) / dict_id.strip()] if dict_id and dict_id.strip() else []), Path(rules) / "source_filters", Path(rules)]
    return next((p for f in folders for p in (f / "source_filters.yml", f / "source_filters.yaml") if p.is_file()), None)


def load_filters(rules: str | Path, dict_id: str | None = None) -> FilterConfig | None:
    path = find_filters(rules, dict_id)
    return filters_of(read_yaml(path), str(Path(rules).resolve().parent)) if path else None


def symbols(rules: str | Path, dict_id: str | None = None) -> tuple[str, ...]:
    """The known symbols of a corpus, else the shared ones: the keys of a map or a list."""
    folders = [*([Path(rules) / dict_id] if dict_id else []), Path(rules)]
    for path in (f / n for f in folders for n in ("symbols.yml", "symbols.yaml")):
        if path.is_file():
            try:
                known = read_yaml(path).get("symbols")
            except ConfigError:
                continue
            if isinstance(known, dict | list):
                return tuple(sorted(map(str, known)))
    return ()


def slug_of(text: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    return re.sub("_+", "_", re.sub(r"[^a-z0-9_]+", "_", re.sub(r"\s+", "_", bare))).strip("_")


def unique_slug(base: str, existing: Iterable[str], prefix: str = "corpus") -> str:
    """A slug that no one has: the text's own, or the first free number after it (without a text, after the prefix)."""
    slug, taken = slug_of(base), set(existing)
    if slug and slug not in taken:
        return slug
    stem, n = (slug, 2) if slug else (prefix, 1)
    while f"{stem}_{n}" in taken:
        n += 1
    return f"{stem}_{n}"


@dataclass(frozen=True)
class Project:
    """Folders of a project and the corpora it knows, by id; one of them is active."""

    root: str
    corpora: tuple[tuple[str, str], ...] = ()
    active: str | None = None

    FOLDERS = ("data/raw/imports", "data/interim", "data/derived", "rules", "logs")

    @staticmethod
    def create(root: str | Path, templates: str | Path | None = None) -> Project:
        """Folders that are missing, and the template files that the rules folder lacks."""
        for f in Project.FOLDERS:
            (Path(root) / f).mkdir(parents=True, exist_ok=True)
        for t in sorted(Path(templates).rglob("*.yml")) if templates else []:
            goal = Path(root) / "rules" / t.relative_to(templates)
            if not goal.exists():
                goal.parent.mkdir(parents=True, exist_ok=True)
                goal.write_bytes(t.read_bytes())
        return Project(str(root))

    def with_corpus(self, label: str) -> Project:
        id_ = unique_slug(label, (c for c, _ in self.corpora))
        return replace(self, corpora=(*self.corpora, (id_, label.strip() or id_)), active=self.active or id_)

    def renamed(self, id_: str, label: str) -> Project:
        self._known(id_)
        return replace(self, corpora=tuple((c, label.strip() if c == id_ else n) for c, n in self.corpora))

    def activated(self, id_: str) -> Project:
        self._known(id_)
        return replace(self, active=id_)

    def _known(self, id_: str) -> None:
        if id_ not in dict(self.corpora):
            raise KeyError(f"no corpus {id_}")

    def template_sources(self) -> list[str]:
        """Imported files that templates read, sorted."""
        return sorted(str(p) for p in (Path(self.root) / "data/raw/imports").rglob("*") if p.is_file() and p.suffix.lower() in (".txt", ".csv"))

    def source_for(self, template: str) -> str:
        """The first import of the kind that a template reads."""
        suffix = ".csv" if template == "csv_mapping" else ".txt"
        for s in self.template_sources():
            if s.lower().endswith(suffix):
                return s
        raise FileNotFoundError(f"no {suffix} among the imports")
