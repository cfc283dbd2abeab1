"""Declarative rules: validated on the driver, compiled to Columns, evaluated in one projection.

A rule has conditions (all, any, none; nested), a scope (feeds, folders, tags) and actions. Rules are evaluated in
order of position and name; a rule that matches and says ``stop`` ends evaluation for the entry.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlake.functions.text import display_title, fold, fold_signs, fold_text, number_or_length, stripped

FIELDS = ("title", "content", "author", "url", "feed", "lang", "any")
OPS = ("contains", "not_contains", "equals", "starts_with", "ends_with", "regex", "not_regex", "gt", "lt")
ACTIONS = ("tag", "untag", "star", "mark_read", "notify", "export", "stop")


class RuleError(ValueError):
    """The rule isn't valid."""


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: str
    case_sensitive: bool = False

    def __post_init__(self):
        if self.field not in FIELDS or self.op not in OPS:
            raise RuleError(f"unknown field or operation: {self.field} {self.op}")
        if self.op.endswith("regex"):
            try:
                re.compile(self.value)
            except re.error as e:
                raise RuleError(f"bad pattern {self.value!r}: {e}") from e

    def folds(self) -> set[str]:
        """The field, if its folded text is looked at."""
        return set() if self.case_sensitive or self.op in ("regex", "not_regex", "gt", "lt") else {self.field}

    def column(self, row: dict[str, Column], folded: dict[str, Column]) -> Column:
        raw = row[self.field]
        if self.op.endswith("regex"):
            flags = "(?U)" if self.case_sensitive else "(?iuU)"
            hit = F.coalesce(raw, F.lit("")).rlike(flags + re.sub(r"\(\?P<", "(?<", self.value))
            return ~hit if self.op == "not_regex" else hit
        if self.op in ("gt", "lt"):
            try:
                bound = float(self.value)
            except ValueError:
                return F.lit(False)
            left = number_or_length(F.coalesce(raw, F.lit("")))
            return left > bound if self.op == "gt" else left < bound
        text = F.coalesce(raw, F.lit("")) if self.case_sensitive else folded[self.field]
        want = F.lit(self.value if self.case_sensitive else fold_text(self.value))
        return {
            "contains": lambda: F.contains(text, want),
            "not_contains": lambda: ~F.contains(text, want),
            "equals": lambda: text == want,
            "starts_with": lambda: F.startswith(text, want),
            "ends_with": lambda: F.endswith(text, want),
        }[self.op]()


@dataclass(frozen=True)
class Group:
    """Every one of ``all``, one of ``any`` if there are any, none of ``none``; an empty group holds."""

    all: Sequence[Condition | Group] = ()
    any: Sequence[Condition | Group] = ()
    none: Sequence[Condition | Group] = ()

    def folds(self) -> set[str]:
        """Fields whose folded text some condition looks at."""
        return set().union(*(c.folds() for part in (self.all, self.any, self.none) for c in part))

    def column(self, row: dict[str, Column], folded: dict[str, Column]) -> Column:
        parts = [c.column(row, folded) for c in self.all]
        if self.any:
            parts.append(reduce(lambda a, b: a | b, (c.column(row, folded) for c in self.any)))
        parts += [~c.column(row, folded) for c in self.none]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


@dataclass(frozen=True)
class Rule:
    name: str
    when: Group = field(default_factory=Group)
    then: Sequence[tuple[str, str]] = ()
    feeds: Sequence[str] = ()
    folders: Sequence[str] = ()
    tags: Sequence[str] = ()
    position: int = 0
    enabled: bool = True

    def __post_init__(self):
        if unknown := [a for a, _ in self.then if a not in ACTIONS]:
            raise RuleError(f"unknown action: {unknown}")

    @property
    def stops(self) -> bool:
        return any(a == "stop" and v != "false" for a, v in self.then)

    @property
    def effects(self) -> list[tuple[str, str]]:
        """Actions before the rule's own stop."""
        out = []
        for a, v in self.then:
            if a == "stop" and v != "false":
                break
            if a != "stop":
                out.append((a, v))
        return out

    def scope(self) -> Column:
        """Any of the given feeds (id, title, own title, url), folders (id, name of the direct folder) or tags; names in
        the folded columns that ``with_folded_names`` adds."""
        tests = []
        for ref in self.feeds:
            tests.append((F.col("feed_id") == ref) | (F.col("feed_url") == ref) | (F.col("_fold_feed_title") == fold_text(ref)) | (F.col("_fold_feed_custom") == fold_text(ref)))
        for ref in self.folders:
            tests.append((F.col("folder_id") == ref) | (F.col("_fold_folder_name") == fold_text(ref)))
        for ref in self.tags:
            tests.append(F.array_contains("_fold_tags", fold_text(ref)))
        return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(True)


def _conditions(items) -> list:
    out = []
    for item in items or []:
        if set(item) & {"all", "any", "none"}:
            out.append(read_group(item))
        else:
            if extra := set(item) - {"field", "op", "value", "case_sensitive"}:
                raise RuleError(f"unknown keys: {sorted(extra)}")
            out.append(Condition(item["field"], item.get("op", "contains"), str(item["value"]), bool(item.get("case_sensitive"))))
    return out


def read_group(spec: dict) -> Group:
    if extra := set(spec) - {"all", "any", "none"}:
        raise RuleError(f"unknown keys: {sorted(extra)}")
    return Group(*(tuple(_conditions(spec.get(k))) for k in ("all", "any", "none")))


def _action(item) -> tuple[str, str]:
    """``{tag: x}``, or a bare name, or ``{notify: true}``."""
    if isinstance(item, str):
        return item, "true"
    if len(item) != 1:
        raise RuleError("an action has one key")
    name, value = next(iter(item.items()))
    return name, str(value).lower() if isinstance(value, bool) else str(value)


def read_rules(text: str) -> list[Rule]:
    """Rules of a YAML text: a list, or a mapping with ``rules``. All are checked before any is returned."""
    data = yaml.safe_load(text) or []
    rules = []
    for k, item in enumerate(data.get("rules", []) if isinstance(data, dict) else data):
        if extra := set(item) - {"name", "enabled", "position", "when", "scope", "then"}:
            raise RuleError(f"unknown keys: {sorted(extra)}")
        scope = item.get("scope") or {}
        rules.append(Rule(item["name"], read_group(item.get("when") or {}), tuple(_action(a) for a in item.get("then") or []), tuple(scope.get("feeds", ())), tuple(scope.get("folders", ())), tuple(scope.get("tags", ())), item.get("position", k), item.get("enabled", True)))
    return rules


def write_rules(rules: Sequence[Rule]) -> str:
    """YAML without defaults; reading it gives the same rules."""

    def conditions(items):
        return [group(c) if isinstance(c, Group) else {"field": c.field, "op": c.op, "value": c.value} | ({"case_sensitive": True} if c.case_sensitive else {}) for c in items]

    def group(g):
        return {k: conditions(v) for k, v in (("all", g.all), ("any", g.any), ("none", g.none)) if v}

    out = []
    for k, r in enumerate(ordered(rules, False)):
        item: dict = {"name": r.name}
        if not r.enabled:
            item["enabled"] = False
        if r.position != k:
            item["position"] = r.position
        if when := group(r.when):
            item["when"] = when
        if scope := {k: list(v) for k, v in (("feeds", r.feeds), ("folders", r.folders), ("tags", r.tags)) if v}:
            item["scope"] = scope
        item["then"] = [{a: v} for a, v in r.then]
        out.append(item)
    return yaml.safe_dump({"rules": out}, allow_unicode=True, sort_keys=False)


def ordered(rules: Sequence[Rule], enabled_only: bool = True) -> list[Rule]:
    return sorted((r for r in rules if r.enabled or not enabled_only), key=lambda r: (r.position, r.name))


def candidates(archive) -> DataFrame:
    """Entries with all that rules look at; tags as they are before evaluation. Names of feeds and folders are folded
    here, in their own small tables."""
    feeds = archive.feeds.select("feed_id", "folder_id", F.col("title").alias("feed_title"), F.col("custom_title").alias("feed_custom"), F.col("url").alias("feed_url"))
    feeds = feeds.select("*", *(fold(F.col(c)).alias(f"_fold_{c}") for c in ("feed_title", "feed_custom")))
    folders = archive.folders.select("folder_id", F.col("name").alias("folder_name"), fold(F.col("name")).alias("_fold_folder_name"))
    tags = archive.entry_tags.filter(~F.col("deleted")).groupBy("entry_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    rows = archive.entries.join(feeds, "feed_id", "left").join(folders, "folder_id", "left").join(tags, "entry_id", "left")
    return rows.withColumns({"author": F.lit(""), "url": F.concat(F.lit("https://example.org/"), F.col("entry_id").cast("string"))})


def with_folded_names(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows with the folded names that scopes of the rules ask for, where they aren't there already."""
    wanted = [c for asked, names in ((any(r.feeds for r in rules), ("feed_title", "feed_custom")), (any(r.folders for r in rules), ("folder_name",))) if asked for c in names]
    rows = rows.select("*", *(fold(F.col(c)).alias(f"_fold_{c}") for c in wanted if f"_fold_{c}" not in rows.columns))
    return rows.withColumn("_fold_tags", F.transform("tags", fold)) if any(r.tags for r in rules) else rows


def _fold_fields(rows: DataFrame, used: set[str]) -> DataFrame:
    """A folded column for each used field. What ``any`` is made of is folded once for all fields that hold it."""
    parts = {"title": "title", "content": "_content", "author": "author"}
    once = [f for f in parts if f in used or "any" in used]
    rows = rows.select("*", *(fold_signs(F.col(parts[f])).alias(f"_signs_{f}") for f in once))
    folded = {f: stripped(F.col(f"_signs_{f}")) for f in once if f in used} | {f: fold(F.col(f"_raw_{f}")) for f in used - {*parts, "any"}}
    if "any" in used:
        folded["any"] = stripped(F.concat_ws(" \n", *(F.when(F.col(parts[f]) != "", F.col(f"_signs_{f}")) for f in parts)))
    return rows.select("*", *(c.alias(f"_fold_{f}") for f, c in folded.items()))


def evaluate(rows: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("entry_id",)) -> DataFrame:
    """``keep`` columns, rules (names that apply, in order) and actions (array of rule, action, value).

    Each text field that a rule looks at in folded form is folded once into a column of its own; every rule is then one
    boolean expression, and the first stopping rule cuts the list of matches. An entry's content is its body, or its summary (if rows have one)
    where there is no body.
    """
    rules = ordered(rules)
    content = F.coalesce(F.nullif(F.col("body_text"), F.lit("")), F.col("summary")) if "summary" in rows.columns else F.col("body_text")
    rows = rows.withColumn("_content", content)
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    raw = {
        "title": F.col("title"), "content": F.col("_content"), "author": F.col("author"), "url": F.col("url"), "lang": F.col("lang"),
        "feed": display_title(F.col("feed_custom"), F.col("feed_title"), F.col("feed_url")), "any": F.concat_ws(" \n", some("title"), some("_content"), some("author")),
    }
    folded = {f: F.col(f"_fold_{f}") for f in FIELDS}
    rows = rows.select("*", *(raw[f].alias(f"_raw_{f}") for f in FIELDS))
    rows = _fold_fields(with_folded_names(rows, rules), set().union(*(r.when.folds() for r in rules)))
    row = {f: F.col(f"_raw_{f}") for f in FIELDS}
    hits = F.array(*(r.scope() & r.when.column(row, folded) for r in rules)) if rules else F.array().cast("array<boolean>")
    rows = rows.select(*keep, hits.alias("_hits"))
    stops = [k for k, r in enumerate(rules) if r.stops]
    end = F.least(*(F.when(F.col("_hits")[k], F.lit(k)).otherwise(F.lit(len(rules))) for k in stops), F.lit(len(rules))) if stops else F.lit(len(rules))
    rows = rows.withColumn("_end", end)
    names = [F.when(F.col("_hits")[k] & (F.lit(k) <= F.col("_end")), F.lit(r.name)) for k, r in enumerate(rules) if r.effects]
    actions = [
        F.when(F.col("_hits")[k] & (F.lit(k) <= F.col("_end")), F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(a).alias("action"), F.lit(v).alias("value")) for a, v in r.effects)))
        for k, r in enumerate(rules)
        if r.effects
    ]
    kind = "array<struct<rule:string,action:string,value:string>>"
    return rows.select(
        *keep,
        (F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")).alias("rules"),
        (F.flatten(F.array_compact(F.array(*actions))) if actions else F.array().cast(kind)).alias("actions"),
    )


def effects(evaluated: DataFrame) -> DataFrame:
    """A row per action: entry_id, place, rule, action, value; the source of ops, notifications and export jobs."""
    return evaluated.select("entry_id", F.posexplode("actions").alias("place", "a")).select("entry_id", "place", "a.*")


def as_ops(done: DataFrame) -> DataFrame:
    """Effects on state as change-log writes: (entry_id, field, val)."""
    state = {"star": ("starred", F.lit("true")), "mark_read": ("read", F.lit("true")), "tag": ("tag", F.col("value")), "untag": ("untag", F.col("value"))}
    name = F.coalesce(*(F.when(F.col("action") == a, F.lit(f)) for a, (f, _) in state.items()))
    value = F.coalesce(*(F.when(F.col("action") == a, v) for a, (_, v) in state.items()))
    return done.filter(F.col("action").isin(list(state))).select("entry_id", name.alias("field"), value.alias("val")).distinct()


def notifications(done: DataFrame, entries: DataFrame) -> DataFrame:
    """Notifications of notify actions: title (given, or the rule's name), body (the entry's title), feed as tag."""
    title = F.when(F.col("value").isin("true", "True"), F.col("rule")).otherwise(F.col("value"))
    rows = done.filter("action = 'notify'").join(entries.select("entry_id", F.col("title").alias("body"), "feed_id", F.col("published_at_ms").alias("ts_ms")), "entry_id")
    return rows.select("entry_id", "rule", title.alias("title"), "body", F.array("feed_id").alias("tags"), "ts_ms")


def export_jobs(done: DataFrame) -> DataFrame:
    """(target, entry_id) of export actions, each once: a target's job is its rows, however many."""
    return done.filter("action = 'export'").select(F.col("value").alias("target"), "entry_id").distinct()


def backfill_summary(evaluated: DataFrame) -> DataFrame:
    """How many entries were looked at, and how many a rule applied to."""
    return evaluated.agg(F.count("*").alias("reviewed"), F.count_if(F.size("rules") > 0).alias("affected"))
