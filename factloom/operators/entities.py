"""Entity dictionary, entity linking and name resolution."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import once
from factloom.session import stage

# Up to this many rows a dictionary side is broadcast; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000

ALIAS_SCHEMA = (
    "key_token string, alias_rank int, entity string, type string, whole_token boolean, pattern string"
)
LINK_TYPE = "array<struct<alias_rank:int,entity:string,type:string>>"


@dataclass(frozen=True)
class Entity:
    name: str
    type: str
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class EntityDictionary:
    """Entities in definition order; ``unbounded`` aliases match inside words as well."""

    entities: tuple[Entity, ...]
    unbounded: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def from_table(cls, table: str, unbounded: Iterable[str] = ()) -> EntityDictionary:
        """Lines of ``name | type | alias; alias``."""
        rows = (line.split(" | ") for line in table.strip().split("\n"))
        return cls(
            tuple(Entity(name, kind, tuple(al.split("; "))) for name, kind, al in rows),
            frozenset(unbounded),
        )

    @cached_property
    def ranked_aliases(self) -> list[tuple[int, str, Entity]]:
        """(rank, alias, entity): longer aliases first, else in definition order."""
        listed = [(a, e) for e in self.entities for a in (*e.aliases, e.name)]
        listed.sort(key=lambda pair: -len(pair[0]))
        return [(rank, alias, entity) for rank, (alias, entity) in enumerate(listed)]

    @property
    def types(self) -> dict[str, str]:
        return {e.name: e.type for e in self.entities}

    @cached_property
    def alias_rows(self) -> list[tuple]:
        """Aliases with the token that must stand in a text before the alias can.

        Inside an alias each run of letters and digits is delimited by other characters or by the
        asked word boundary, so it is a whole token of every text that matches.  The longest run is
        the most telling one.  Aliases without such a run, and unbounded ones, are found by a plain
        substring test; their key starts with a character no token has.
        """
        rows = []
        for rank, alias, entity in self.ranked_aliases:
            tokens = re.findall("[a-z0-9]+", alias.lower())
            quoted = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", alias)
            if alias in self.unbounded:
                key, whole, pattern = f"\x01{alias.lower()}", True, ""
            else:
                key = max(tokens, key=len) if tokens else f"\x01{alias.lower()}"
                whole = alias.lower() == key
                pattern = f"(?i)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])"
            rows.append((key, rank, entity.name, entity.type, whole, pattern))
        return rows

    def alias_table(self, spark: SparkSession) -> DataFrame:
        return _bounded(spark.createDataFrame(self.alias_rows, ALIAS_SCHEMA), len(self.alias_rows))

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, e.type, i) for i, e in enumerate(self.entities)]
        return _bounded(
            spark.createDataFrame(rows, "node string, type string, def_ord int"), len(rows)
        )

    def key_table(self, spark: SparkSession) -> DataFrame:
        """Comparison key to the first entity defined with it."""
        rows = [(a, e.name, i) for i, e in enumerate(self.entities) for a in (e.name, *e.aliases)]
        names = spark.createDataFrame(rows, "alias string, entity string, def_ord int")
        keyed = names.groupBy(tx.entity_key(F.col("alias")).alias("name_key")).agg(
            F.min_by("entity", "def_ord").alias("entity")
        )
        return _bounded(keyed.where("name_key <> ''"), len(rows))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


DEFAULT_DICTIONARY = EntityDictionary.from_table(fv.ENTITY_TABLE, fv.UNBOUNDED_ALIASES)


def _keys_present(text: Column, keys: list[str]) -> Column:
    """Those alias keys that stand in the text: tokens by set intersection, the rest as substrings."""
    lowered = F.lower(text)
    tokens = [k for k in keys if not k.startswith("\x01")]
    scans = [k[1:] for k in keys if k.startswith("\x01")]
    empty = F.array().cast("array<string>")
    present = empty
    if tokens:
        text_tokens = F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0))
        present = F.array_intersect(text_tokens, F.array(*map(F.lit, tokens)))
    if scans:
        hits = [F.when(F.contains(lowered, F.lit(k)), F.lit(f"\x01{k}")) for k in scans]
        present = F.concat(present, F.array_compact(F.array(*hits)))
    return present


def _first_per_entity(links: Column) -> Column:
    """Keep the best alias of each entity; the order found is the order of those aliases."""
    return F.aggregate(
        F.array_sort(links),
        F.array().cast(LINK_TYPE),
        lambda kept, link: F.when(
            F.exists(kept, lambda k: k["entity"] == link["entity"]), kept
        ).otherwise(F.concat(kept, F.array(link))),
    )


def link_inline(text: Column, dictionary: EntityDictionary) -> Column:
    """Entities of a text as an array in the order found, evaluated inside the row.

    No join and no shuffle: the few keys found in the text open their aliases in a literal map, and
    only aliases of several tokens are checked by regex.
    """
    by_key: dict[str, list[Column]] = {}
    for key, rank, entity, kind, whole, pattern in dictionary.alias_rows:
        alias = F.struct(
            F.lit(rank).alias("alias_rank"),
            F.lit(entity).alias("entity"),
            F.lit(kind).alias("type"),
            F.lit(whole).alias("whole"),
            F.lit(pattern).alias("pattern"),
        )
        by_key.setdefault(key, []).append(alias)
    entries = F.create_map(
        *(part for key, aliases in by_key.items() for part in (F.lit(key), F.array(*aliases)))
    )

    def look_up(keys: Column) -> Column:
        candidates = F.flatten(F.transform(keys, lambda k: F.element_at(entries, k)))
        matching = F.filter(candidates, lambda a: a["whole"] | F.rlike(text, a["pattern"]))
        slim = F.transform(
            matching,
            lambda a: F.struct(
                a["alias_rank"].alias("alias_rank"),
                a["entity"].alias("entity"),
                a["type"].alias("type"),
            ),
        )
        return F.when(F.size(keys) > 0, _first_per_entity(slim)).otherwise(
            F.array().cast(LINK_TYPE)
        )

    return tx.let(_keys_present(text, list(by_key)), look_up)


def link_by_join(
    df: DataFrame, text: str, dictionary: EntityDictionary, into: str = "entities"
) -> DataFrame:
    """The same for dictionaries of any size: tokens meet alias keys in a join.

    Rows get a key of their own, so they may repeat and have nulls anywhere.  Only keys and tokens are
    exploded; a text meets the aliases that its tokens opened once, in its row.
    """
    row = "_link_row"
    keyed = stage(df.withColumn(row, F.monotonically_increasing_id()), "link-rows")
    lowered = F.lower(F.col(text))
    tokens = F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)))
    scans = [r[0][1:] for r in dictionary.alias_rows if r[0].startswith("\x01")]
    if scans:
        hits = [F.when(F.contains(lowered, F.lit(k)), F.lit(f"\x01{k}")) for k in set(scans)]
        tokens = F.concat(tokens, F.array_compact(F.array(*hits)))
    fields = ("alias_rank", "entity", "type", "whole_token", "pattern")
    opened = (
        keyed.select(row, F.explode(tokens).alias("key_token"))
        .join(dictionary.alias_table(df.sparkSession), "key_token")
        .groupBy(row)
        .agg(F.collect_set(F.struct(*fields)).alias("_opened"))
    )
    fitting = F.filter(
        F.col("_opened"), lambda a: a["whole_token"] | F.rlike(F.col(text), a["pattern"])
    )
    slim = F.transform(
        fitting,
        lambda a: F.struct(a["alias_rank"].alias("alias_rank"), a["entity"].alias("entity"), a["type"].alias("type")),
    )
    links = F.when(F.col("_opened").isNull(), F.array().cast(LINK_TYPE)).otherwise(_first_per_entity(slim))
    return keyed.join(opened, row, "left").withColumn(into, links).drop(row, "_opened")


def with_entities(
    df: DataFrame, text: str, dictionary: EntityDictionary, into: str = "entities", by_join: bool = False
) -> DataFrame:
    """Add the entities of a text column: in the row, or by join where a plan can't hold the dictionary."""
    if by_join:
        return link_by_join(df, text, dictionary, into)
    return once(df, into, link_inline(F.col(text), dictionary))


def resolve_names(
    df: DataFrame, columns: Iterable[str], dictionary: EntityDictionary
) -> DataFrame:
    """Replace names by the entity that has an alias of equal key; other names are only cleaned."""
    for column in columns:
        cleaned = tx.clean_text(F.col(column))
        keys = dictionary.key_table(df.sparkSession).select(
            F.col("name_key").alias("_key"), F.col("entity").alias("_entity")
        )
        own_kind = F.col(column).startswith("doc:") | F.col(column).startswith("metric:")
        df = (
            df.withColumn(column, cleaned)
            .withColumn("_key", F.when(~own_kind, tx.entity_key(F.col(column))))
            .join(keys, "_key", "left")
            .withColumn(column, F.coalesce("_entity", column))
            .drop("_key", "_entity")
        )
    return df


def node_type(name: Column, fallback: Column, dictionary: EntityDictionary) -> Column:
    """Type of a dictionary entity, else the fallback."""
    known = dictionary.types
    if not known:
        return fallback
    types = F.create_map(*(F.lit(part) for pair in known.items() for part in pair))
    return F.coalesce(F.element_at(types, name), fallback)


def type_by_name(name: Column, dictionary: EntityDictionary) -> Column:
    """Type of a node read back from a file, where only the name is known."""
    return (
        F.when(name.startswith("doc:"), F.lit("Document"))
        .when(name.startswith("metric:"), F.lit("Metric"))
        .otherwise(node_type(name, F.lit("Entity"), dictionary))
    )
