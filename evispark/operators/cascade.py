"""Ordered rules over items, compiled to one column expression that keeps an audit trail of what each rule changed.

A rule sees the item as earlier rules left it.  The state (status, value, confidence, notes, codes, done, audit) is folded
over the rules of the item's field inside one ``aggregate``, so the expression grows with the number of rules and not with
how often a rule looks at the state; nothing is collected or joined, and every rule runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an applied rule leaves in the trail.
ENTRY = "struct<rule:string,kind:string,severity:string,before:string,after:string>"
Expression = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """``when`` and the changes are functions of the state; fields ending in ``.`` name a whole category, none all fields.

    Of the exclusive rules of a field the first that applies is the only one; others apply wherever they fit.  Rules see
    items whose status is ``needs`` only.  A rejected item loses value, confidence and codes.
    """

    name: str
    when: Expression
    fields: tuple[str, ...] = ()
    value: Expression | None = None
    status: str | None = None
    note: str | Expression | None = None
    notes: Expression | None = None
    reject: bool = False
    clear_codes: bool = False
    exclusive: bool = True
    kind: str = "value_normalized"
    severity: str = "info"
    needs: str = "found"

    def concerns(self, field: str) -> bool:
        return not self.fields or any(field == f or (f.endswith(".") and field.startswith(f)) for f in self.fields)


def appended(notes: Column, note: Column) -> Column:
    return F.concat_ws("; ", F.nullif(notes, F.lit("")), note)


def _applied(rule: Rule, s: Column) -> Column:
    """The state after a rule."""
    value = F.lit(None).cast("string") if rule.reject else s["value"] if rule.value is None else rule.value(s)
    notes = s["notes"] if rule.notes is None else rule.notes(s)
    if rule.note is not None:
        notes = appended(notes, F.lit(rule.note) if isinstance(rule.note, str) else rule.note(s))
    entry = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.severity).alias("severity"), s["value"].alias("before"), value.alias("after"))
    status = "not_found" if rule.reject else rule.status
    return F.struct(
        (s["status"] if status is None else F.lit(status)).alias("status"), value.alias("value"), (F.lit(0.0) if rule.reject else s["confidence"]).alias("confidence"), notes.alias("notes"),
        (F.array().cast("array<string>") if rule.reject or rule.clear_codes else s["codes"]).alias("codes"), (F.lit(True) if rule.exclusive else s["done"]).alias("done"), F.concat(s["audit"], F.array(entry)).alias("audit"),
    )


def _folded(rules: Sequence[Rule], start: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        out = s
        for k, rule in reversed(list(enumerate(rules))):
            fits = (s["status"] == rule.needs) & F.coalesce(rule.when(s), F.lit(False))
            if rule.exclusive:
                fits = ~s["done"] & fits
            out = F.when(i == k, F.when(fits, _applied(rule, s)).otherwise(s)).otherwise(out)
        return out

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(rules) - 1)), start, step) if rules else start


def apply(items: DataFrame, rules: Sequence[Rule], fields: Sequence[str]) -> DataFrame:
    """items (field_id, status, value, and confidence, notes and codes if there) after the rules, with an ``audit`` column.

    ``fields`` are the field ids or categories that rules tell apart; other fields see the rules of all fields only.  An
    earlier audit is carried on.
    """
    have = {c: F.col(c) for c in items.columns}
    empty = F.array().cast(f"array<{ENTRY}>")
    start = F.struct(
        F.col("status").alias("status"), F.col("value").cast("string").alias("value"), have.get("confidence", F.lit(None)).cast("double").alias("confidence"), have.get("notes", F.lit(None)).cast("string").alias("notes"),
        F.coalesce(have.get("codes", F.lit(None)).cast("array<string>"), F.array().cast("array<string>")).alias("codes"), F.lit(False).alias("done"), (F.coalesce(have["audit"], empty) if "audit" in have else empty).alias("audit"),
    )
    state = _folded([r for r in rules if not r.fields], start)
    for field in reversed(fields):
        own = [r for r in rules if r.concerns(field)]
        here = F.startswith("field_id", F.lit(field)) if field.endswith(".") else F.col("field_id") == field
        state = F.when(here, _folded(own, start)).otherwise(state)
    made = ["status", "value", "confidence", "notes", "codes", "audit"]
    after = items.withColumn("_state", state)
    return after.select(*(c for c in items.columns if c not in made), *(F.col(f"_state.{c}").alias(c) for c in made))


def issues(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each applied rule: keys, its place in the item's trail, rule, kind, severity, value before and after."""
    return items.select(*keys, F.posexplode("audit").alias("step", "_a")).select(*keys, "step", "_a.*")
