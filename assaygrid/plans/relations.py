"""Named relations and queries as declarative plan texts; Catalyst sees one tree per query."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from ..functions.dialect import CHECK, SPARK, render
from ..operators.graph import components
from ..operators.selection import ranked
from ..sources.scratch import written

#: Macros of tables that Spark makes beforehand.
MADE = {"components": components, "ranked": ranked}
#: Rows that a task of a dealt relation holds on average, at most.
ROWS = 500_000
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df by its first column, in parts whose number grows with the rows; where the cores suffice, Spark chooses."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, df.columns[0]) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def named(text: str) -> list[str]:
    """Names that a plan text reads from, as often as it does."""
    return re.findall(r"\b(?:FROM|JOIN)\s+(?:\{\w+:)?(\w+)", text)


def reads(text: str) -> set[str]:
    return set(named(text))


class Catalogue:
    """Relations by name, queries by name; a query brings the relations it needs, in order."""

    def __init__(self):
        self.relations: dict[str, str] = {}
        self.queries: dict[str, str] = {}
        self.checks: dict[str, str] = {}
        self.own: dict[str, str] = {}
        self.stored: set[str] = set()

    def relation(self, name: str, text: str, stored: bool = False) -> None:
        """``stored``: a query that would work the relation out more than once writes it and reads it back instead."""
        self.relations[name] = text.strip()
        if stored:
            self.stored.add(name)

    def spark(self, name: str, text: str, stored: bool = False) -> None:
        """How Spark works a relation out where the checking text of its name does it another way, or has no use for it."""
        self.own[name] = text.strip()
        if stored:
            self.stored.add(name)

    def texts(self, macros: dict) -> dict[str, str]:
        return self.relations if macros is CHECK else {**self.relations, **self.own}

    def query(self, name: str, text: str) -> None:
        self.queries[name] = text.strip()

    def check(self, name: str, text: str) -> None:
        """A checking text of a query that does not share the query's relations."""
        self.checks[name] = text.strip()

    def needed(self, text: str, held: set[str] = frozenset(), macros: dict = SPARK) -> list[str]:
        """The relations that a text reads, each after those it reads itself; what is held needs nothing."""
        out: list[str] = []
        known = self.texts(macros)

        def visit(part: str) -> None:
            for n in sorted(reads(part) & known.keys()):
                if n not in out:
                    if n not in held:
                        visit(known[n])
                    out.append(n)

        visit(text)
        return list(dict.fromkeys(out))

    def repeated(self, body: str, held: set[str]) -> list[str]:
        """The stored relations that a text, its other relations put in place, would work out more than once."""
        order, times, known = self.needed(body, held), Counter(named(body)), self.texts(SPARK)
        out = []
        for n in reversed(order):
            if n in held:
                continue
            again = n in self.stored and times[n] > 1
            if again:
                out.append(n)
            for m in named(known[n]):
                times[m] += 1 if again else times[n]
        return out[::-1]

    def text(self, name: str, macros: dict, base: Callable[[str], str] | None = None, held: set[str] = frozenset(), params: dict | None = None) -> str:
        known = self.texts(macros)
        body = self.queries.get(name) or known[name]
        own = self.needed(body, held, macros)
        parts = [f"{n} AS (SELECT * FROM {{stored_{n}}})" if n in held else f"{n} AS ({known[n]})" for n in own]
        if base:
            words = reads(body + " " + " ".join(parts))
            parts = [f"{t} AS (SELECT * FROM {base(t)})" for t in TABLES if t in words] + parts
        return render((f"WITH {', '.join(parts)} " if parts else "") + body, macros, params)

    def plan(self, spark: SparkSession, name: str, base: Callable[[str], str], held: dict[str, DataFrame], params: dict | None = None) -> DataFrame:
        """The query or relation over tables by ``base`` and the relations that are held; what is stored is written and held."""
        if name in held:
            return held[name]
        body = self.queries.get(name) or self.texts(SPARK)[name]
        for n in self.repeated(body, set(held)):
            if n not in held:
                held[n] = written(self.plan(spark, n, base, held, params), n)
        text = self.text(name, SPARK, base, set(held), params)
        tables = {f"{kind}_{t}": MADE[kind](self.plan(spark, t, base, held, params)) for kind, t in set(re.findall(r"\{(components|ranked)_(\w+)\}", text))}
        for t in set(re.findall(r"\{dealt_(\w+)\}", text)):
            read = sorted(reads(self.texts(SPARK)[t]) & set(TABLES))
            rows = max(spark.sql(f"SELECT count(*) FROM {base(x)}").first()[0] for x in read)
            tables[f"dealt_{t}"] = dealt(self.plan(spark, t, base, held, params), rows)
        return spark.sql(text, **tables, **{f"stored_{n}": df for n, df in held.items() if f"{{stored_{n}}}" in text})

    def run(self, name: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: self.plan(spark, name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", {})

    def over(self, name: str, held: dict[str, DataFrame], **params) -> DataFrame:
        """A query or relation over a caller's own relations, which take the place of those of the same names.

        ``held`` also receives the relations written on the way, for further queries over the same ones.
        """
        return self.plan(next(iter(held.values())).sparkSession, name, lambda t: t, held, params)

    def check_sql(self, name: str) -> str:
        return self.checks.get(name) or self.text(name, CHECK)


CATALOGUE = Catalogue()
