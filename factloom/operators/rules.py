"""Sentence rules that turn wording into facts; the rules are data, one projection applies them all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx

Groups = tuple[tuple[str, ...], ...]

RULE_FACT_TYPE = "array<struct<source:string,relation:string,target:string,weight:decimal(18,6)>>"


@dataclass(frozen=True)
class SubjectRule:
    """For every entity of ``subject_type``: a metric built from the numbers of the sentence."""

    relation: str
    kind: str
    groups: Groups


@dataclass(frozen=True)
class FixedRule:
    """One fixed fact; ``verbatim`` phrases are compared with case."""

    source: str
    relation: str
    target: str
    groups: Groups
    verbatim: Groups = ()


@dataclass(frozen=True)
class FanRule:
    """One source related to every other entity of the sentence."""

    source: str
    relation: str
    groups: Groups


@dataclass(frozen=True)
class RuleSet:
    subject_rules: Sequence[SubjectRule]
    fixed_rules: Sequence[FixedRule]
    fan_rules: Sequence[FanRule]
    subject_type: str = "Company"
    subject_weight: float = fv.COMPANY_RULE_WEIGHT
    fixed_weight: float = fv.FIXED_RULE_WEIGHT
    fan_weight: float = fv.FAN_RULE_WEIGHT

    @classmethod
    def from_tables(cls, subjects: str, fixed: str, fans: str) -> RuleSet:
        """Tables with one rule per line: `` | `` parts fields, `` & `` groups, ``, `` phrases."""

        def groups(text: str) -> Groups:
            return tuple(tuple(g.split(", ")) for g in text.split(" & ") if g)

        def lines(table: str) -> list[list[str]]:
            return [
                [f.strip() for f in line.split("|")] for line in table.strip().split("\n") if line
            ]

        return cls(
            [SubjectRule(r, k, groups(g)) for r, k, g in lines(subjects)],
            [FixedRule(s, r, t, groups(g), groups(v)) for s, r, t, g, v in lines(fixed)],
            [FanRule(s, r, groups(g)) for s, r, g in lines(fans)],
        )


DEFAULT_RULES = RuleSet.from_tables(fv.COMPANY_RULE_TABLE, fv.FIXED_RULE_TABLE, fv.FAN_RULE_TABLE)


def _fact(source: Column, relation: str, target: Column, weight: float) -> Column:
    return F.struct(
        source.alias("source"),
        F.lit(relation).alias("relation"),
        target.alias("target"),
        F.lit(weight).cast("decimal(18,6)").alias("weight"),
    )


def _fan_facts(rule: FanRule, lowered: Column, entities: Column, weight: float) -> Column:
    others = F.filter(entities, lambda e: e["entity"] != rule.source)
    fan = F.transform(
        others, lambda e: _fact(F.lit(rule.source), rule.relation, e["entity"], weight)
    )
    return F.when(
        tx.contains_all_groups(lowered, rule.groups), fan.cast(RULE_FACT_TYPE)
    ).otherwise(F.array().cast(RULE_FACT_TYPE))


def rule_facts(sentence: Column, entities: Column, rules: RuleSet) -> Column:
    """Facts of one sentence in rule order, as an array.

    ``entities`` is the array of linked entities of the sentence in the order found.
    """
    none = F.array().cast(RULE_FACT_TYPE)

    def build(lowered: Column, found: Column) -> Column:
        def of_subject(entity: Column) -> Column:
            first_numbers = F.array_join(F.slice(found, 1, 3), ", ")
            facts = [
                F.when(
                    tx.contains_all_groups(lowered, rule.groups),
                    _fact(
                        entity["entity"],
                        rule.relation,
                        tx.metric_node(
                            F.concat(
                                entity["entity"], F.lit(f" {rule.kind}: "), first_numbers
                            )
                        ),
                        rules.subject_weight,
                    ),
                )
                for rule in rules.subject_rules
            ]
            return F.array_compact(F.array(*facts)) if facts else none

        subjects = F.filter(entities, lambda e: e["type"] == rules.subject_type)
        by_subject = F.when(
            F.size(found) > 0, F.flatten(F.transform(subjects, of_subject))
        ).otherwise(none)

        fixed = [
            F.when(
                tx.contains_all_groups(lowered, rule.groups)
                & tx.contains_all_groups(sentence, rule.verbatim),
                _fact(F.lit(rule.source), rule.relation, F.lit(rule.target), rules.fixed_weight),
            )
            for rule in rules.fixed_rules
        ]
        parts = [by_subject.cast(RULE_FACT_TYPE)]
        if fixed:
            parts.append(F.array_compact(F.array(*fixed)).cast(RULE_FACT_TYPE))
        parts += [_fan_facts(rule, lowered, entities, rules.fan_weight) for rule in rules.fan_rules]
        return F.concat(*parts)

    return tx.let(
        F.lower(sentence),
        lambda lowered: tx.let(tx.numbers(sentence), lambda found: build(lowered, found)),
    )
