"""Rule files: read, validated, and planned into expressions.

A rule has exactly one of lit, re, word_re and builtin.  Files of a user's own have the same format.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

from prosegauge.functions import text as T

HERE = Path(__file__).parent / "rules"
SETS = ("ru", "en", "code")
#: word_re uses up the characters beside the word, so matches can't share one.
WORD_START, WORD_STOP = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
#: Rules that RE2 can't say.  The patterns are for java.util.regex.
BUILTINS = {
    "en_dash": "–(?:(?<![0-9] {0,200}–)|(?! *[0-9]))",
    "latin_in_cyrillic": "[a-z](?<=[А-Яа-яЁё][a-z])(?=[А-Яа-яЁё])",
    "fake_range": "",
}
FAKE_RANGE = "(?i)" + WORD_START + r"от\s+([а-яё]+)\s+до\s+([а-яё]+)" + WORD_STOP
HARD = "HARD BAN"


class RuleError(ValueError):
    """A rule file says something that can't be meant."""


@dataclass(frozen=True)
class Rule:
    set: str
    place: int
    category: str
    name: str
    kind: str
    pattern: str
    fix: str
    lift: float
    tests: tuple = ()

    @property
    def hard(self) -> bool:
        return self.category == HARD

    @property
    def re2(self) -> str:
        """The regex as RE2 has it, case folded."""
        if self.kind == "lit":
            return "(?i)" + T.quoted(self.pattern)
        if self.kind == "word_re":
            return "(?i)" + WORD_START + f"(?:{self.pattern})" + WORD_STOP
        return "(?i)" + self.pattern

    @property
    def jdk(self) -> str:
        return BUILTINS[self.pattern] if self.kind == "builtin" and self.pattern != "fake_range" else T.jdk(FAKE_RANGE if self.kind == "builtin" else self.re2)


@dataclass(frozen=True)
class RuleSet:
    name: str
    thresholds: dict
    freq_bans: dict
    rules: tuple[Rule, ...]
    copy_paste: str
    genres: dict = field(hash=False, default_factory=dict)

    @property
    def bans(self) -> list[Rule]:
        return [r for r in self.rules if r.hard]

    @property
    def markers(self) -> list[Rule]:
        return [r for r in self.rules if not r.hard]

    def muted(self, genre: str) -> tuple[set[str], set[str], set[str]]:
        """Bans, categories and rules that the genre takes away; an unknown genre takes nothing."""
        g = self.genres.get(genre, {})
        return set(g.get("mute_bans") or ()), set(g.get("mute_categories") or ()), set(g.get("mute_rules") or ())

    def cv_target(self, genre: str) -> float:
        return self.genres.get(genre, {}).get("cv_human_target") or self.thresholds["cv_human_target"]

    def is_muted(self, rule: Rule, genre: str) -> bool:
        bans, categories, rules = self.muted(genre)
        return rule.name in bans if rule.hard else rule.category in categories or rule.name in rules


def _rule(spec: dict, name: str, place: int, category: str, fix: str, lift: float) -> Rule:
    kinds = [k for k in ("lit", "re", "word_re", "builtin") if spec.get(k)]
    if len(kinds) != 1:
        raise RuleError(f"{name}: {category}: rule {spec.get('name') or spec}: exactly one of lit, re, word_re and builtin is needed")
    kind, pattern = kinds[0], spec[kinds[0]]
    if kind == "builtin" and pattern not in BUILTINS:
        raise RuleError(f"{name}: no builtin {pattern!r}; there are {', '.join(BUILTINS)}")
    title = spec.get("name") or (pattern if kind == "lit" else "")
    if not title:
        raise RuleError(f"{name}: {category}: a rule without a name: {pattern}")
    own = float(spec.get("lift") or 0)
    return Rule(name, place, category, title, kind, pattern, fix or "", own or float(lift or 0), tuple((t["text"], bool(t["expect"])) for t in spec.get("tests") or ()))


def parse(name: str, y: dict) -> RuleSet:
    rules: list[Rule] = []
    for spec in y.get("hard_bans") or ():
        rules.append(_rule(spec, name, len(rules), HARD, spec.get("fix", ""), 0))
    for c in y.get("categories") or ():
        for spec in c.get("rules") or ():
            rules.append(_rule(spec, name, len(rules), c["name"], c.get("fix", ""), c.get("lift") or 0))
    if not rules:
        raise RuleError(f"{name}: no rules")
    bans = {r.name for r in rules if r.hard}
    categories, markers = {r.category for r in rules if not r.hard}, {r.name for r in rules if not r.hard}
    for genre, g in (y.get("genres") or {}).items():
        for key, known in (("mute_bans", bans), ("mute_categories", categories), ("mute_rules", markers)):
            for x in g.get(key) or ():
                if x not in known:
                    raise RuleError(f"{name}: genre {genre}: {key}: there is no {x!r}")
    for x in y.get("freq_bans") or {}:
        if x not in bans:
            raise RuleError(f"{name}: freq_bans: there is no {x!r}")
    return RuleSet(name, dict(y.get("thresholds") or {}), dict(y.get("freq_bans") or {}), tuple(rules), y.get("copy_paste_category") or "", dict(y.get("genres") or {}))


@lru_cache(maxsize=32)
def load_rules(name: str = "ru", path: str | None = None) -> RuleSet:
    """A built-in set by name, or the file at path."""
    import yaml

    if path is None and name not in SETS:
        raise RuleError(f"no built-in set {name!r}")
    source = Path(path) if path else HERE / f"{name}.yaml"
    return parse(name, yaml.safe_load(source.read_text(encoding="utf-8")))


def allowed(rules: list[Rule], only: list[str] = (), disable: list[str] = ()) -> list[Rule]:
    """By rule or category name, whatever the case."""
    only_, off = {x.lower() for x in only}, {x.lower() for x in disable}
    said = lambda r, names: r.name.lower() in names or r.category.lower() in names
    return [r for r in rules if (not only_ or said(r, only_)) and not said(r, off)]
